"""Collocations against a plain count of everything, with small buffers, exact big numbers, and odd inputs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from factloom.llm import collocations as c


def plain(rows, least, longest=5, top=2000, absorbed=100):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {x: n for x, n in counts.items() if len(x[1]) > 1 and n >= least}
    inside = Counter()  # the most frequent longer candidate around a phrase
    for (lang, p), n in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside[lang, p[i : i + k]], n)
    out = {}
    for (lang, p), a in found.items():
        if inside[lang, p] and 100 * inside[lang, p] >= absorbed * a:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, ps in out.items() for i, (s, a, p, l, r) in enumerate(sorted(ps)[:top]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    idioms = ["once upon a Time", "Kind regards", "on the other hand side", "É è", "zz zz zz zz zz zz", "\x1c x"]
    out = [(None, None), ("en", ""), ("en", " \t"), ("de", ".,;:!?\n"), (None, "on the other hand, side on"), ("und", "on the other hand")]
    for k in range(150):
        words = [rng.choice(idioms) if rng.random() < 0.2 else rng.choice("abcdefghij") * rng.randint(1, 2) + rng.choice(["", "", "", ".", ",", "\n", "\t", "!?"]) for _ in range(rng.randint(1, 50))]
        out.append((rng.choice(["en", "de", None]), " ".join(words)))
    out += [out[-1]] * 30  # repeated rows count each
    out.append(("en", "once upon a time " * 9_000))
    return out


def got(spark, rows, **given):
    df = spark.createDataFrame([(k, *r, "q", 3) for k, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int").repartition(5)
    return sorted(tuple(r) for r in c.collocations(df, **given).collect())


@pytest.mark.parametrize(("least", "absorbed", "top"), [(4, 100, 2000), (12, 70, 9)])
def test_collocations_match_a_plain_count(spark, rows, least, absorbed, top):
    want = plain(rows, least, top=top, absorbed=absorbed)
    assert got(spark, rows, least=least, absorbed=absorbed, top=top) == want
    assert {len(x[2].split(" ")) for x in want} >= {2, 4} and {x[0] for x in want} == {"en", "de", "und"}


def test_small_buffers_give_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(c, "VOCABULARY", 12)  # the tasks' function takes these along
    monkeypatch.setattr(c, "HELD", 40)
    assert got(spark, rows, least=4) == plain(rows, 4)


def test_rows_are_summed_by_themselves_where_hashes_meet():
    rows = np.array([[1, 2], [1, 3], [1, 2], [2, 2]], np.int32)
    _, kept, counts = c.summed(np.array([7, 7, 7, 9], np.uint64), rows, np.array([1, 2, 3, 4]))
    assert dict(zip(map(tuple, kept.tolist()), counts.tolist(), strict=True)) == {(1, 2): 4, (1, 3): 2, (2, 2): 4}


def test_scores_are_exact_beyond_64_bits(spark):
    total, a, left, right = 9_876_543_210_987, 1_234_567_890_123, 2_345_678_901_234, 1_999_999_999_999
    frequent = spark.createDataFrame([("en", "x", 1, left), ("en", "y", 1, right), ("en", "x y", 2, a)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", total)], "lang string, total long")
    row = c.ranked(frequent, totals).first()
    assert (row.score, row.l, row.r, row.n) == (1000 * a * total // (left * right), left, right, total)
    # a whole quotient less a hair must not be rounded up
    frequent = spark.createDataFrame([("en", "x", 1, 10**13), ("en", "y", 1, 10**12), ("en", "x y", 2, 10**12 - 1)], "lang string, phrase string, words int, f long")
    assert c.ranked(frequent, spark.createDataFrame([("en", 10**13)], "lang string, total long")).first().score == 999


def test_empty_tables_and_tables_without_phrases(spark):
    assert got(spark, []) == [] and got(spark, [("en", None), (None, "a b c")]) == []
