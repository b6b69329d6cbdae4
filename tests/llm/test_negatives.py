"""Hard negatives against a plain scan, with few rows a bucket so that both rounds and the bounds are used, and on odd inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import negatives as n

SCHEMA = "vec_id long, label int, embedding array<double>, norm double, key long"


def plain(rows, asked, positives=5, k=10, least=30, most=90):
    used = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(256 * x) for x in v]
            if sum(x * x for x in whole) < 1 << 62:
                used.setdefault(i, []).append((label, whole))
    used = {i: min(x) for i, x in used.items()}
    lengths = [len(v) for _, v in used.values()]
    length = min(set(lengths), key=lambda d: (-lengths.count(d), d), default=0)
    used = {i: x for i, x in used.items() if len(x[1]) == length}
    out = []
    for i, (label, v) in used.items():
        if not asked(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other == label) for j, (other, w) in used.items() if j != i)
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            fits = [x for x in scored if not x[2] and least * -s <= 100 * -x[0] <= most * -s][:k]
            out += [(i, j, rank + 1, x[1], -s, -x[0]) for rank, x in enumerate(fits)]
    return sorted(out)


def got(spark, rows, condition, **given):
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in n.hard_negatives(df, condition, **given).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    out = []
    for i in range(900):
        centre = rng.choice(centres)
        size = rng.choice([0.05, 0.3, 1, 1, 3])
        out.append((i, rng.randrange(4), [size * (c + rng.gauss(0, 0.4)) for c in centre]))
    out += [(1000 + i, 1, out[0][2]) for i in range(60)] + [(1100 + i, 2, out[0][2]) for i in range(60)]  # equal vectors
    out += out[:5]  # repeated rows
    out += [(3, 0, [0.5] * 6), (4, 3, [0.25] * 6)]  # other rows of one id
    out += [(2000, None, [1.0] * 6), (2001, 1, None), (2002, 1, []), (2003, 1, [1.0, None] * 3), (2004, 1, [math.nan] * 6), (2005, 1, [math.inf] * 6), (None, 1, [1.0] * 6)]
    out += [(2006, 1, [1.0] * 5), (2007, 2, [0.0] * 6), (2008, 9, [1.0] * 6), (2009, 1, [1e300] * 6), (2010, 1, [-0.001] * 6)]
    return out


@pytest.mark.parametrize(("bucket_rows", "piece_rows"), [(32_768, 65_536), (60, 7)])
def test_negatives_match_a_plain_scan(spark, rows, monkeypatch, bucket_rows, piece_rows):
    monkeypatch.setattr(n, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(n, "PIECE_ROWS", piece_rows)
    want = plain(rows, lambda i: i % 10 == 0)
    assert got(spark, rows, F.col("vec_id") % 10 == 0) == want and len(want) > 3000
    assert got(spark, rows, F.col("vec_id") % 100 == 7, positives=3, negatives=2, least=0, most=100) == plain(rows, lambda i: i % 100 == 7, 3, 2, 0, 100)


def test_blocks_stop_at_the_bound_and_lose_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (6000, 5)) * rng.integers(1, 40, (6000, 1))
    norms = np.sqrt((x * x).sum(axis=1)) * (1 + 1e-12)
    order = np.argsort(-norms)
    labels = rng.integers(0, 3, 6000)
    cell = n._Cell(np.arange(6000)[order], labels[order], norms[order], x[order])
    q, own = x[:50], np.zeros(50, np.int64)
    limits = np.tile(np.array([[0, 10**7, -(1 << 62)], [10**5, 10**6, -(1 << 62)], [1 << 62, -(1 << 62), 1 << 62]]), (50, 1, 1))
    keys, ids, scores = cell.search(np.arange(50), own, norms[:50], q, limits, False, 4)
    for i in range(50):
        every = sorted((-int(s), j) for j, s in enumerate(x @ q[i]) if labels[j] != 0)
        for w, (low, high) in enumerate([(0, 10**7), (10**5, 10**6), (1, 0)]):
            want = [(j, -s) for s, j in every if low <= -s <= high][:4]
            assert [(a, b) for k, a, b in zip(keys.tolist(), ids.tolist(), scores.tolist(), strict=True) if k == 3 * i + w] == want


def test_scores_are_exact_beyond_doubles(spark):
    rows = [(0, 1, [4_000_000.003, 1.0]), (1, 1, [4_000_000.007, 3.0]), (2, 2, [2_000_000.003, 1.0]), (3, 2, [2_000_000.007, 5.0]), (4, 2, [3_999_999.0, 2.0])]
    assert got(spark, rows, F.col("vec_id") == 0) == plain(rows, lambda i: i == 0) != []


def test_empty_tables(spark):
    assert got(spark, [], F.lit(True)) == [] and got(spark, [(0, 1, [1.0])], F.lit(True)) == []
    assert got(spark, [(0, 1, None)], None) == []
