import pytest

from tests.llm.data import empty, frame, rows
from tokenloom.llm import quality

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    train, test = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    out = quality.quality_scores(docs, train).join(test, "doc_id").collect()
    assert len(out) > 500
    right = sum(r.keep == (r.quality > 0) for r in out) / len(out)
    clean = [r.keep for r in out if r.quality > 0]
    base = max(len(clean), len(out) - len(clean)) / len(out)
    print(f"accuracy {right:.4f}, base {base:.4f}, clean kept {sum(clean) / len(clean):.4f}")
    assert right > 0.97 and sum(clean) / len(clean) > 0.99


def test_scores_are_calibrated(spark, tables):
    docs, labels = tables
    out = quality.quality_scores(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    brier = sum((r.score - (r.quality > 0)) ** 2 for r in out) / len(out)
    rate = sum(r.quality > 0 for r in out) / len(out)
    assert brier < 0.25 * rate * (1 - rate)


def test_rejects_leave_and_columns_stay(spark, tables):
    docs, labels = tables
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    scores = quality.quality_scores(docs, labels)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in scores.where("keep").collect())


def test_awkward_rows_and_labels(spark):
    marks = [(i, i % 2, 0) for i in range(12)] + [(1, None, 0), (None, 1, 0), (2, 0, 0), (99999, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = quality.quality_scores(frame(spark), labels).collect()
    assert len(out) == len(rows()) and all(0 <= r.score <= 1 for r in out)
    assert quality.keep_good(frame(spark), labels).columns == frame(spark).columns


def test_no_labels_reject_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.quality_scores(frame(spark), none).collect()] == [0.5] * len(rows())
    assert quality.keep_good(frame(spark), none).count() == len(rows())
    assert quality.quality_scores(empty(spark), none).collect() == []


def test_copies_do_not_keep_other_documents_from_being_learnt(spark):
    import numpy as np

    wide = [n for n in quality.widths()]
    a, b = (lambda v: [float(v)] + [0.0] * (wide[0] - 1)), (lambda u, v=0.0: [float(u), float(v)] + [0.0] * (wide[1] - 2))
    rng = np.random.default_rng(1)
    known = [(i, a((1 if i % 2 else -1) * (2 + rng.random())), b(rng.normal())) for i in range(80)]
    copies = [(1000 + i, a(6 if i % 2 else -6), b(0)) for i in range(4000)]
    # unlabelled documents, less extreme than the copies, tell the other view what its second column means
    other = [(9000 + i, a((1 if i % 2 else -1) * (4 + rng.random())), b(rng.normal(), 1 if i % 2 else -1)) for i in range(200)]
    rows_ = [(d, n, x, y) for n, (d, x, y) in enumerate(known + copies + other)]
    featured = spark.createDataFrame(rows_, "doc_id long, row long, a array<double>, b array<double>")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    model = quality.fit(featured, labels).models[1]
    low, high = model.logit(np.array([b(0, -1), b(0, 1)]))
    assert low < -1 and high > 1


def test_languages_and_sources_count_by_their_own_name(spark):
    langs = ["de", "es", None, "", "?"]  # de and es, and the last three, shared one value
    docs = [(i, "the same plain text", langs[i % 5], f"s{i % 3}", 19) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 in (0, 2))) for i in range(400)], "doc_id long, quality int")
    frame_ = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    keep = {r.doc_id: r.keep for r in quality.quality_scores(frame_, labels).collect()}
    base = frame_.selectExpr("doc_id", "doc_id as row", "lang", "source", "n_chars").withColumn("a", quality.text_view(quality.F.lit("x")))
    odds = {r.value: r.odds for r in quality.name_rates(base, labels)["lang"].collect()}
    assert set(odds) == set(langs) and all((odds[x] > 1) == (x in ("de", None)) for x in langs)
    assert keep == {i: i % 5 in (0, 2) for i in range(400)}
