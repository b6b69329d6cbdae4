"""SimHash groups against brute force, with hot halves cut and uncut, and on odd inputs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import simhash


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    """Smallest index of each one's component."""
    found = list(range(len(fps)))

    def top(i):
        while found[i] != i:
            i = found[i]
        return i

    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= 2:
                a, b = top(i), top(j)
                found[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeÉ") for _ in range(rng.randint(1, 7)))
    base = [word() for _ in range(400)]
    out = [None, "", " \t\n", "one", "ONE", "two words", "two words", "a b c", "A\x0bB\x0cC", " ".join(base)]
    for k in range(60):  # near copies of a long text, and copies of copies
        changed = list(base)
        for _ in range(rng.randint(0, 6)):
            changed[rng.randrange(len(changed))] = word()
        out.append(" ".join(changed))
    out += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(40)]
    out.append(" ".join(word() for _ in range(250_000)))  # read in pieces
    return out


def test_fingerprints_are_those_of_the_plain_rule(texts):
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t)
    assert len(texts[-1]) > 1 << 20


@pytest.mark.parametrize("hot", [simhash.HOT, 2])
def test_groups_match_brute_force(spark, texts, hot):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, fp string, id long").repartition(3)
    got = {r.doc_id: r for r in simhash.near_groups(df, hot=hot).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == fps and all(len(r.fingerprint) == 16 for r in got.values())
    assert [got[i].component_id for i in range(len(texts))] == plain_groups(fps)


@pytest.mark.parametrize(("n", "spread"), [(900, (0, 20)), (2600, (30, 64)), (2600, (0, 12)), (1500, (32, 44))])
@pytest.mark.parametrize("hot", [8, 1024])
def test_groups_of_unlike_fingerprints_are_linked_exactly(spark, n, spread, hot):
    """Fingerprints that agree but in some bits: halves are hot, buckets are searched by flips."""
    rng = np.random.default_rng(n + spread[0])
    weights = np.uint64(1) << np.arange(*spread, dtype=np.uint64)
    fps = np.unique(np.uint64(0xDEADBEEF01234567) ^ (rng.integers(0, 2, (n, len(weights))).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64))
    df = spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long").repartition(4)
    edges = simhash.links(simhash.variants(df, hot)).collect()
    where = {x: i for i, x in enumerate(fps.view(np.int64).tolist())}
    labels = simhash.connect(np.arange(len(fps)), np.array([where[e.a] for e in edges], int), np.array([where[e.b] for e in edges], int))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    a, b = np.nonzero(near)
    assert (labels == simhash.connect(np.arange(len(fps)), a, b)).all()
    assert all((e.a ^ e.b) != 0 for e in edges) and len(edges) <= 98 * len(fps)  # fewer than the index has rows


def test_flips_and_pairs_find_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 18, 1500).astype(np.uint64) << np.uint64(11))
    flipped = simhash.linked(fps)
    monkeypatch.setattr(simhash, "FLIPPED", 1 << 30)
    monkeypatch.setattr(simhash, "PAIRS", 1 << 12)
    assert (flipped == simhash.linked(fps)).all() and len(set(flipped.tolist())) > 1


def test_repeats_nulls_and_empty_tables(spark):
    rows = [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, "q r s t u"), (3, None), (2, ""), (9, "A b c d")]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.component_id is None else r.component_id) for r in got) == [(-1, -1), (-1, 7), (2, 2), (3, 2), (7, 7), (7, 7), (9, 7)]
    assert {r.fingerprint for r in got if r.doc_id in (2, 3)} == {"0" * 16}
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_hash_is_that_of_the_sql_function(spark):
    text = "naïve café 日本"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] & (1 << 64) - 1 == simhash._digest(text.encode())
