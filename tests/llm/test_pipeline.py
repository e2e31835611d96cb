import random
from pathlib import Path

import corpus_pipeline
from tests.llm.data import empty, frame, rows
from tests.llm.test_jaccard import alike, grams
from tests.llm.test_tokens import word_ids
from tokenloom.llm import common, dedup, jaccard, packing, pii, quality
from tokenloom.session import shared_dir

SF = "/root/testdata/sf0.01"


def test_stages_have_the_stated_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram jaccard join", "pii", "packing"]


def python_steps(df):
    """The most Python steps that one stage of a plan has; each keeps a worker a task."""
    most = []

    def below(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return below(node.executedPlan())
        children = node.children()
        n = max([below(children.apply(i)) for i in range(children.size())], default=0)
        if "Exchange" in node.nodeName():
            most.append(n)
            return 0
        return n + ("EvalPython" in node.nodeName() or "InArrow" in node.nodeName())

    return max([below(df._jdf.queryExecution().executedPlan()), *most])


def test_stages_run_one_python_step_at_a_time(spark):
    docs, none = frame(spark), spark.createDataFrame([], "doc_id long, quality int")
    plans = [quality.keep_good(docs, none), dedup.drop_copies(docs), jaccard.keep_one(docs), pii.redact(docs), packing.pack(docs)]
    assert [python_steps(p) for p in plans] == [1, 1, 1, 1, 1]


def rows_of(df):
    out = {r.doc_id: r for r in df.collect()}
    assert len(out) == df.count()
    return out


def near_classes(texts):
    """Components of documents of 0.8 or more, all pairs of possible sizes compared."""
    sets = {i: grams(t) for i, t in texts.items()}
    order, root = sorted(sets, key=lambda i: len(sets[i])), {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if len(sets[j]) * 0.8 > len(sets[i]):
                break
            if alike(sets[i], sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in sets}


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, after = docs.columns, [rows_of(docs)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns, name
        after.append(rows_of(docs))
    start, good, unique, apart, clean = after

    keep = {r.doc_id for r in quality.quality_scores(spark.read.parquet(f"{SF}/documents.parquet"), common.read(spark, SF, "labels")).where("keep").collect()}
    labels = {r.doc_id: r.quality for r in common.read(spark, SF, "labels").collect()}
    assert set(good) == keep and all(good[i] == start[i] for i in good)
    kept_good = [i in good for i, q in labels.items() if q and i in start]
    kept_bad = [i in good for i, q in labels.items() if q == 0 and i in start]
    assert sum(kept_good) > 0.9 * len(kept_good) and sum(kept_bad) < 0.5 * len(kept_bad)

    last = {}
    for i, r in sorted(good.items()):
        last[(r.text or "").encode().lower()] = i
    assert unique == {i: good[i] for i in last.values()}

    classes = near_classes({i: r.text or "" for i, r in unique.items()})
    assert len(set(classes.values())) < len(classes)
    assert apart == {i: unique[i] for i in set(classes.values())}

    assert set(clean) == set(apart)
    for i, r in clean.items():
        found = pii.base_spans(apart[i].text or "")
        assert not pii.base_spans(r.text or "")
        if not found:
            assert r == apart[i]
        else:
            text, parts, done = apart[i].text, [], 0
            for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
                if s >= done:
                    parts += [text[done:s], f"<{pii.KINDS[kind].upper()}>"]
                done = max(done, e)
            assert r.text == "".join(parts) + text[done:] and r.n_chars == len(r.text)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.length for r in pieces) == sum(len(word_ids(r.text)) + 1 for r in clean.values())
    assert {r.doc_id for r in pieces} == set(clean)


def test_awkward_tables_pass_every_stage(spark):
    for docs in (frame(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.materialise(stage(spark, docs, SF), "test-stage")
            assert docs.columns == frame(spark).columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert (pieces.count() > 0) == (docs.count() > 0)
    assert rows()


def written(spark, make):
    """Bytes that building and reading a result leaves in the shared folder."""

    def size():
        return sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet"))

    before = size()
    make().write.format("noop").mode("overwrite").save()
    return size() - before


def test_stages_write_no_copy_of_the_texts(spark):
    rng = random.Random(3)
    # digits of random bytes are hardly compressible beyond the half
    texts = [rng.randbytes(4000).hex() + f" a{i}@mail.example.com" for i in range(300)]
    docs = frame(spark, [(i, t, "en", "s1", len(t), "k", i, "r") for i, t in enumerate([*texts, *texts[:30]])])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    copy = len(texts) * 4000
    for make in (lambda: quality.keep_good(docs, labels), lambda: dedup.drop_copies(docs), lambda: pii.redact(docs)):
        assert written(spark, make) < 0.25 * copy


def test_labels_are_joined_once(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    featured, _, model = quality.trained(docs, labels)
    assert model is not None
    assert {r.doc_id: r.y for r in featured.where("y is not null").collect()} == {r.doc_id: r.quality for r in labels.collect()}
    assert featured.count() == len(rows())
