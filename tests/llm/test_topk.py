import math
import random

import numpy as np
import pytest

from tokenloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string"


def brute(table, every=20, k=20):
    good = [(i, [math.floor(64.0 * float(np.float32(x))) for x in v]) for i, v in table if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in good if i % every == 0}.items():
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


def run(spark, table, **args):
    df = spark.createDataFrame([(i, v, 0, "r", "s") for i, v in table], SCHEMA)
    return {tuple(r) for r in topk.search(df, **args).collect()}


def clusters(n, dim, spread, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, spread) for c in centres[i % 5]]) for i in range(n)]


@pytest.mark.parametrize("table", [
    clusters(300, 64, 0.05),
    clusters(200, 7, 1.0),
    [(i, [0.5, -0.25, 1.0]) for i in range(90)],  # all tie
    clusters(9, 4, 0.2) + [(20, None), (None, [1.0, 1.0, 1.0, 1.0]), (40, [1.0, None, 0.0, 0.0]), (60, [1.0, float("nan"), 0.0, 0.0]), (80, [1.0, float("inf"), 0.0, 0.0]), (100, [])] + [(0, [3.0, 1.0])] * 2 + [(1, [1.0, 2.0])],
])
def test_equals_brute_force(spark, table):
    if len({i for i, _ in table}) == len(table):
        assert run(spark, table) == brute(table)
    else:
        one = [(i, v) for i, v in dict(table).items()]
        assert run(spark, one) == brute(one)


def test_small_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "SEEDS", 30)
    monkeypatch.setattr(topk, "ROUND_BYTES", 3000)
    table = clusters(260, 16, 0.3)
    assert run(spark, table, every=4, k=5) == brute(table, 4, 5)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = np.floor(rng.normal(0, 40, (40, 30))), np.floor(rng.normal(0, 40, (50, 30)))
    exact = a @ b.T
    coarse, fine = (topk.statistics(a, s) @ topk.statistics(b, s).T for s in topk.SEGMENTS)
    assert (coarse >= fine - 1e-6).all() or (coarse >= exact - 1e-6).all()
    assert (fine >= exact - 1e-6).all() and (coarse >= exact - 1e-6).all()


def test_empty_table(spark):
    assert run(spark, []) == set()


def exact(x):
    return 64 * int(x) if abs(x) >= 2.0**53 else math.floor(64.0 * x)


def brute_doubles(table, every=20, k=20):
    rows = [(i, [exact(x) for x in v]) for i, v in table if all(map(math.isfinite, v))]
    out = set()
    for q, a in {i: v for i, v in rows if i % every == 0}.items():
        scores = [(max(-topk.LONG, min(topk.LONG, sum(x * y for x, y in zip(a, b)))), i) for i, b in rows if i != q]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted((-s, i) for s, i in scores)[:k])}
    return out


@pytest.mark.parametrize("scale", [3e6, 1e9, 1e18, 1e200])
def test_large_components_are_exact(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "SEEDS", 40)
    rng = random.Random(8)
    close = [rng.uniform(-1, 1) for _ in range(12)]
    table = [(i, [scale * (c + (rng.gauss(0, 1e-9) if i % 3 else rng.gauss(0, 1))) for c in close]) for i in range(150)]
    table += [(200, [1e308] + [0.0] * 11), (201, [-1e308] + [1.0] * 11), (202, [0.0] * 12), (203, [0.0, 1.0] + [0.0] * 10), (204, [float("inf")] * 12)]
    table += [(220, [2.0**70, -(2.0**70)] + [0.25] * 10), (221, [1.0, 1.0] + [0.5] * 10), (240, [1.0] * 12)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.search(df).collect()} == brute_doubles(table)


def test_the_sample_does_not_grow_with_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SEEDS", 30)
    table = clusters(1200, 8, 0.3)
    df = spark.createDataFrame([(i, v, 0, "r", "s") for i, v in table], SCHEMA)
    seen = []
    plain = topk.query_blocks
    monkeypatch.setattr(topk, "query_blocks", lambda q, seeds, k: seen.append(sum(len(s[0]) for s in seeds.values())) or plain(q, seeds, k))
    results = [{tuple(r) for r in topk.search(df.repartition(n)).collect()} for n in (2, 24)]
    assert results[0] == results[1] and seen[0] == seen[1] < 90
