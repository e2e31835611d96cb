"""Quality classifier (7): co-training of two views.

View one is the text (shares of byte classes, repetition of words and lines,
lengths), view two the page metadata (length on record, language, source).
A language or source counts by its own name: its smoothed log-odds of good
quality over the labels (without those held out) and over what the text view,
trained on labels alone, is sure of. They are joined to the documents from a
written table: Spark broadcasts it below its threshold, else shuffles and splits
skewed keys.
Each view has its own logistic regression. In every round both score all
unlabelled documents, and each hands all it is sure of, with their
pseudo-labels, to the other's training set. Documents with equal features count
once, so a group of copies is one point; the pseudo-labels of a class weigh at
most as much as its labels do. They stay in Spark, which adds up the sums of
each Newton step. At the end each view is calibrated
on held-out labels, and the calibrated log-odds are added to score all
documents.

Bounds (parameters): at most ``LABELLED`` labelled documents, the smallest by
hash of doc_id, train and calibrate. Everything else covers all documents.

Defined cases: null text counts as empty, null metadata as a value of its own;
labels with null quality are left out and the lowest of several labels holds;
without labels of both classes every score is 0.5 and nothing is rejected;
null and repeated doc_ids are scored like any other row.
"""

from __future__ import annotations

import copy
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, fresh, materialise, small_batches, tidy

LABELLED, ROUNDS = 20_000, 3
SURE, REJECT = 0.95, 0.5
STEPS = 25  # Newton steps at most
HELD_OUT = 4  # one labelled document in HELD_OUT calibrates
SMOOTH = 10.0  # weight of the overall rate in that of a language or source

_CLASS = np.zeros(256, np.int64)  # byte classes: 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 sentence mark, 7 symbol, 8 non-ASCII
for _chars, _kind in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b" \t", 4), (b"\n", 5), (b".,;:?'\"-()", 6), (b"!#$%&*+/<=>@[\\]^_`{|}~", 7), (range(128, 256), 8)):
    _CLASS[list(_chars)] = _kind


def text_features(raw: bytes) -> list[float]:
    n = max(1, len(raw))
    shares = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 9) / n
    words, lines = raw.split(), raw.split(b"\n")
    w = max(1, len(words))
    counts = Counter(words)
    common = sum(c for _, c in counts.most_common(3)) / w
    stay = sum(a == b for a, b in zip(words, words[1:])) / w
    size = sum(map(len, words)) / w
    odd = sum(not x[-1:].isalnum() and x[-1] < 128 for x in words) / w
    bare = sum(len(x) == 1 and not x.isalnum() for x in words) / w
    shout = sum(x.isupper() for x in words) / w
    return [*shares.tolist(), len(counts) / w, common, stay, min(size, 40.0), odd, bare, shout, 1 - len(set(lines)) / len(lines), np.log1p(len(words)), np.log1p(len(raw) / len(lines))]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def text_view(text: pa.Array) -> pa.Array:
    parts = (as_bytes(text.slice(a, 256)) for a in range(0, len(text), 256))  # few texts are copied at a time
    return pa.array([text_features(x) for part in parts for x in part], pa.list_(pa.float64()))


NAMES = ("lang", "source")


def with_meta(docs: DataFrame, rates: dict[str, DataFrame], b: str) -> DataFrame:
    """The documents with the features of the metadata view."""
    meta = [F.log1p(F.greatest(F.lit(0), F.coalesce(F.col("n_chars").cast("long"), F.lit(0))).cast("double")), F.col("n_chars").isNull().cast("double")]
    out = docs
    for name, rate in rates.items():
        value, odds = fresh(out, f"{name}_value", f"{name}_odds")
        out = out.join(rate.select(F.col("value").alias(value), F.col("odds").alias(odds)), F.col(name).cast("string").eqNullSafe(F.col(value)), "left")
        meta += [F.coalesce(F.col(odds), F.lit(0.0)), F.col(name).isNull().cast("double")]
    return out.select(*docs.columns, F.array(*meta).alias(b))


def name_rates(base: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> dict[str, DataFrame]:
    """value and odds (log-odds beyond the overall ones) of each language and each source."""
    base = with_marks(base, labels)
    known, y, held = sample(base, labelled)
    kept = base.where("y is not null").join(base.sparkSession.createDataFrame([(r["row"],) for r, h in zip(known, held) if h], "row long"), "row", "left_anti")
    told = kept.select(*NAMES, (F.col("y") > 0).alias("good"), F.lit(True).alias("told"))
    prior = 0.5
    if len(set(y.tolist())) == 2:
        prior, edge = float(y[~held].mean()), float(np.log(SURE / (1 - SURE)))
        text = Logistic(np.array([r["a"] for r in known])[~held], y[~held])
        pool = base.where("y is null").select("a", *NAMES, "n_chars").distinct().withColumn("logit", view_logit(text, widths()[0])("a"))
        told = told.union(pool.where(F.abs("logit") >= edge).select(*NAMES, F.col("logit") > 0, F.lit(False)))
    told = materialise(told, "name-labels")
    n = {(r["told"], r["good"]): r["count"] for r in told.groupBy("told", "good").count().collect()}
    weight = {g: min(1.0, n.get((True, g), 0) / max(1, n.get((False, g), 0))) for g in (True, False)}
    out = {}
    for name in NAMES:
        good, bad = (F.sum(F.when(F.col("good") == g, F.when(F.col("told"), 1.0).otherwise(weight[g])).otherwise(0.0)) for g in (True, False))
        odds = F.log((good + SMOOTH * prior) / (bad + SMOOTH * (1 - prior))) - float(np.log(prior / (1 - prior)))
        out[name] = materialise(told.groupBy(F.col(name).alias("value")).agg(odds.alias("odds")), f"rates-{name}")
    return out


class Logistic:
    """Logistic regression with an L2 penalty on standardised columns, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, spread: tuple[np.ndarray, np.ndarray] | None = None):
        self.mean, self.scale = spread or (x.mean(axis=0), x.std(axis=0) + 1e-9)
        self.scale = np.where(self.scale < 1e-6, np.inf, self.scale)  # a constant column says nothing
        z = self._rows(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(STEPS):
            if self.step(*newton_sums(z, y, self.w)) < 1e-6:
                break

    def step(self, slope: np.ndarray, curve: np.ndarray, penalty: float = 1.0) -> float:
        """Move by one Newton step; the largest change."""
        ridge = penalty * np.eye(len(self.w))
        ridge[0, 0] = 1e-6
        change = np.linalg.solve(curve + ridge, slope - ridge @ self.w)
        self.w = self.w + change
        return float(np.abs(change).max())

    def _rows(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)), axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._rows(x) @ self.w


def newton_sums(z: np.ndarray, y: np.ndarray | float, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = sigmoid(z @ w)
    return z.T @ (y - p), (z * (p * (1 - p))[:, None]).T @ z


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -35, 35)))


class Combined:
    """Both views with their calibrations; None stands for "no labels to learn from"."""

    def __init__(self, models: list[Logistic], calibrations: list[Logistic], prior: float):
        self.models, self.calibrations, self.prior = models, calibrations, prior

    def scores(self, xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by the text, by the metadata and by both."""
        logits = [c.logit(m.logit(x)[:, None]) for m, c, x in zip(self.models, self.calibrations, xs)]
        return sigmoid(logits[0]), sigmoid(logits[1]), sigmoid(logits[0] + logits[1] - self.prior)


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def widths() -> tuple[int, int]:
    return len(text_features(b"")), 2 + 2 * len(NAMES)


def scorer(model: Combined | None):
    kind = pa.float64()

    @F.arrow_udf("struct<p_text double, p_meta double, score double>")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        if model is None:
            parts = [np.full(len(a), 0.5)] * 3
        else:
            parts = model.scores([rows_of(c, w) for c, w in zip((a, b), widths())])
        return pa.StructArray.from_arrays([pa.array(p, kind) for p in parts], ["p_text", "p_meta", "score"])

    return score


def text_scorer(model: Combined | None):
    """``score`` of ``scorer`` from the text itself and the metadata view."""

    @F.arrow_udf("double")
    def score(text: pa.Array, b: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.full(len(text), 0.5))
        out = [np.zeros(0)]
        for at in range(0, len(text), 256):  # few texts are copied at a time
            features = np.array([text_features(x) for x in as_bytes(text.slice(at, 256))])
            out.append(model.scores([features, rows_of(b.slice(at, 256), widths()[1])])[2])
        return pa.array(np.concatenate(out))

    return score


def view_logit(model: Logistic, width: int):
    @F.arrow_udf("double")
    def logit(column: pa.Array) -> pa.Array:
        return pa.array(model.logit(rows_of(column, width)), pa.float64())

    return logit


def marked(labels: DataFrame) -> DataFrame:
    return labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))


def with_marks(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with their label ``y``, null without one; rows that have theirs are not joined again."""
    return rows if "y" in rows.columns else rows.join(marked(labels), "doc_id", "left")


def sample(featured: DataFrame, labelled: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Labelled documents, whether they are good, and which are held out."""
    # written before it is collected: a collected limit sends its number of rows of every task to the driver
    first = featured.where("y is not null").withColumn("place", F.xxhash64("doc_id")).orderBy("place", "row").limit(labelled)
    known = sorted(materialise(first, "labelled-sample").collect(), key=lambda r: (r["place"], r["row"]))
    y = np.array([float(r["y"] > 0) for r in known])
    held = np.arange(len(y)) % HELD_OUT == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)  # too few labels to hold any out: calibrate on what trained
    return known, y, held


def summed(pool: DataFrame, vector, width: int) -> np.ndarray:
    """The sum of ``vector(features of both views)`` over all batches, added up in Spark."""
    sizes = widths()

    def part(batches):
        total = np.zeros(width)
        for batch in batches:
            if len(batch):
                total += vector([rows_of(batch.column(i), n) for i, n in enumerate(sizes)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["i", "v"])

    out = np.zeros(width)
    for r in pool.select("a", "b").mapInArrow(tidy(part), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def spreads(pool: DataFrame, xs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of each view's columns over the pool and the labelled documents."""

    def sums(parts):
        return np.concatenate([np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0))) for x in parts])

    total, out = summed(pool, sums, sum(1 + 2 * n for n in widths())) + sums(xs), []
    for n in widths():
        mean, square = total[1 : 1 + n] / total[0], total[1 + n : 1 + 2 * n] / total[0]
        out.append((mean, np.sqrt(np.maximum(0, square - mean * mean)) + 1e-9))
        total = total[1 + 2 * n :]
    return out


def taught(models: list[Logistic], train: list[tuple[np.ndarray, np.ndarray]], pool: DataFrame) -> list[Logistic]:
    """Both models fitted anew to the labels and to all that the other view is sure of."""
    edge = float(np.log(SURE / (1 - SURE)))
    pupils = [copy.copy(m) for m in models]
    rows = [m._rows(x) for m, (x, _) in zip(models, train)]
    for m in pupils:
        m.w = np.zeros(len(m.w))
    size = [1 + len(m.w) + len(m.w) ** 2 for m in models]
    for _ in range(STEPS):
        now = [m.w for m in pupils]

        def sums(xs, now=now):
            out, logits = [], [m.logit(x) for m, x in zip(models, xs)]
            for m, x, w, other in zip(models, xs, now, reversed(logits)):
                z = m._rows(x)
                for label, sure in ((0.0, other <= -edge), (1.0, other >= edge)):
                    slope, curve = newton_sums(z[sure], label, w)
                    out += [[sure.sum()], slope, curve.ravel()]
            return np.concatenate(out)

        total, change = summed(pool, sums, 2 * sum(size)), 0.0
        for m, z, (_, y), n in zip(pupils, rows, train, size):
            slope, curve = newton_sums(z, y, m.w)
            for label in (0.0, 1.0):
                part, total = total[:n], total[n:]
                weight = min(1.0, (y == label).sum() / max(1.0, part[0]))
                slope, curve = slope + weight * part[1 : 1 + len(m.w)], curve + weight * part[1 + len(m.w) :].reshape(curve.shape)
            change = max(change, m.step(slope, curve))
        if change < 1e-4:
            break
    return pupils


def fit(featured: DataFrame, labels: DataFrame, rounds: int = ROUNDS, labelled: int = LABELLED) -> Combined | None:
    """Co-train on a written frame (doc_id, row, a, b) of all documents' features."""
    featured = with_marks(featured, labels)
    known, y, held = sample(featured, labelled)
    if len(set(y.tolist())) < 2:
        return None
    xs = [np.array([r[c] for r in known]) for c in ("a", "b")]
    train = [(x[~held], y[~held]) for x in xs]
    pool = materialise(featured.where("y is null").select("a", "b").distinct(), "pool")
    models = [Logistic(*t, s) for t, s in zip(train, spreads(pool, [t[0] for t in train]))]
    for _ in range(rounds):
        models = taught(models, train, pool)
    check = held if held.any() else ~held
    calibrations = [Logistic(m.logit(x[check])[:, None], y[check]) for m, x in zip(models, xs)]
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    return Combined(models, calibrations, float(np.log(rate / (1 - rate))))


def trained(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], Combined | None]:
    small_batches(docs.sparkSession)
    names = [F.col(n).cast("string").alias(n) for n in NAMES]
    viewed = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_view("text").alias("a"), *names, F.col("n_chars").cast("long").alias("n_chars"))
    # the labels are joined here only: later steps read them from the written frames
    base = materialise(with_marks(viewed, labels), "text-features")
    rates = name_rates(base, labels)
    featured = materialise(with_meta(base, rates, "b").select("doc_id", "row", "a", "b", "y"), "features")
    return featured, rates, fit(featured, labels)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_text, p_meta, score and keep of every document."""
    featured, _, model = trained(docs, labels)
    return featured.withColumn("s", scorer(model)("a", "b")).select("doc_id", "s.p_text", "s.p_meta", "s.score", (F.col("s.score") >= REJECT).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject."""
    _, rates, model = trained(docs, labels)
    b, s = fresh(docs, "meta_view", "quality_score")
    # features and score in one Python step: no copy of the texts is written
    scored = with_meta(docs, rates, b).withColumn(s, text_scorer(model)("text", b))
    return scored.where(F.col(s) >= REJECT).select(*docs.columns)
