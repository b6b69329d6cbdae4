"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import gzip
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import bpe, chat, chunks, decontaminate, neardup, neighbours, quality, substrings, urls, warc
from factloom.llm.common import scratch_path

DOCS = "doc_id long, text string, id long, kept string, __keys string, digest string, host string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    passage, near = words(rng, 80), words(rng, 120).split()
    out = {0: None, 1: "", 2: " \n\t ", 3: "x", 4: "one two three four", 5: "One Two three FOUR", 6: "aaaa" * 700, 7: "aaaa" * 500}
    out[8] = words(rng, 4000)
    out[9] = out[8][:9000]
    for i in range(10, 18):
        out[i] = words(rng, 60) + "\n" + passage + " " + words(rng, 40)
    for i in range(18, 24):
        changed = list(near)
        changed[i * 3] = "changed"
        out[i] = " ".join(changed)
    out[24], out[25] = out[18], out[18].upper()
    out[26] = words(rng, 70)
    out[27] = "\U0001f600 é" * 40
    out[28] = "z" + "\U0001f600 é" * 40
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, 7, "a", "b", "c", "d") for i, t in texts.items()] + [(None, texts[18], 7, "a", "b", "c", "d")]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect() if r[key] is not None}


def removed(b, i, first):
    """Which bytes of a text are covered by a window that a smaller document has; first: the smallest document of each."""
    gone = bytearray(len(b))
    for k in range(len(b) - 49):
        if first[b[k : k + 50]] < i:
            gone[k : k + 50] = b"\1" * 50
    return bytes(gone)


def test_substrings_match_brute_force(docs, texts, nothing):
    got = by_id(substrings.remove_repeats(docs))
    first = {}
    for i, t in sorted(texts.items()):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t in texts.items():
        b = (t or "").encode()
        gone = removed(b, i, first)
        assert bytes(got[i].kept) == bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert len(got[i].removed_spans) == len(re.findall(b"\1+", bytes(gone))) and got[i].host == "d"
    assert substrings.remove_repeats(nothing).count() == 0


def test_hot_grams_are_compared_window_by_window(spark, docs, texts, monkeypatch):
    rng = random.Random(9)
    line = words(rng, 14)
    rows = [(k, words(rng, 30) + " " + line + " " + words(rng, 30)) for k in range(120)] + [(500 + i, t) for i, t in texts.items()] + [(130, line), (131, line[:60]), (131, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spans = lambda: sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.removed_spans]) for r in substrings.remove_repeats(df).collect())
    whole = spans()
    monkeypatch.setattr(substrings, "HOT_CONTEXTS", 30)
    buckets = substrings.initial_buckets(df, 4)
    assert buckets.where("id IS NULL").count() > 0
    hot = spans()
    assert hot == whole and sum(bool(s) for _, _, s in whole) > 120
    first = {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    plain = sorted((i, len(b), [m.span() for m in re.finditer(b"\1+", removed(b, i, first))]) for i, b in ((i, (t or "").encode()) for i, t in rows))
    assert hot == plain
    monkeypatch.setattr(substrings, "SENT_BYTES", 7)
    assert spans() == whole


@pytest.mark.parametrize("together", [1, 7, 8192])
def test_windows_are_told_apart_by_their_bytes(monkeypatch, together):
    """Also where unlike windows have one hash and stand between equal ones."""
    monkeypatch.setattr(substrings, "REFINED_TOGETHER", together)
    rng = np.random.default_rng(4)
    windows = rng.integers(97, 99, (9, substrings.LENGTH)).astype(np.uint8)[rng.integers(0, 9, 300)]
    windows[::50, 49] ^= 1
    ids = rng.integers(0, 40, 300)
    keys = np.array([k % 2 + 1 for k in windows.sum(axis=1)], np.uint64)  # equal windows have equal hashes
    low = {}
    for w, i in zip(windows, ids.tolist(), strict=True):
        low[bytes(w)] = min(i, low.get(bytes(w), i))
    assert substrings.repeats(windows, ids, keys).tolist() == [i > low[bytes(w)] for w, i in zip(windows, ids.tolist(), strict=True)]
    assert substrings.repeats(windows[:0], ids[:0], keys[:0]).tolist() == []


def test_hashes_are_sent_wide_enough_for_the_anchors():
    assert [substrings.sent_bytes(n) for n in (0, 10**9, 10**11, 10**12, 10**14)] == [5, 5, 5, 6, 7]
    assert all(substrings.sent_bytes(n) <= 8 for n in (10**16, 10**18))


def test_window_hashes_are_of_the_bytes_alone():
    context = np.random.default_rng(3).integers(0, 256, (60, substrings.CONTEXT)).astype(np.uint8)
    context[30:] = context[:30]
    context[45:, 60] ^= 1
    seen = {}
    for row, hashes in zip(context, substrings.window_hashes(context).tolist(), strict=True):
        for o, h in enumerate(hashes):
            assert seen.setdefault(h, bytes(row[o : o + 50])) == bytes(row[o : o + 50])
            assert substrings.window_hashes(row[None, o : o + 50])[0, 0] == h
    assert len(seen) == len({bytes(row[o : o + 50]) for row in context for o in range(35)})


@pytest.mark.parametrize("block", [neardup.BLOCK, 3])
def test_buckets_of_unlike_members_are_compared_in_blocks(spark, monkeypatch, block):
    """A core that all share, with ends of their own: alike in pairs here and there, in one bucket of many."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(12)
    core = words(rng, 60).split()
    rows = {k: " ".join(core[: rng.randint(30, 60)] + words(rng, rng.randint(0, 40)).split()) for k in range(40)}
    got = by_id(neardup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)))
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in ((k, t.split()) for k, t in rows.items())}
    label = {k: k for k in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert {k: r.component_id for k, r in got.items()} == label and 1 < len(set(label.values())) < 40


def test_substrings_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(3)
    t, u = words(rng, 40), words(rng, 40)
    rows = [(1, t), (1, t), (1, u + t), (None, t), (2, u + " " + t)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, sum(s.stop - s.start for s in r.removed_spans)) for r in got) == sorted([(0, 0), (1, 0), (1, 0), (1, 0), (2, len((u + t).encode()))])


def test_buckets_are_refined_to_equal_strings():
    rng = np.random.default_rng(0)
    context = rng.integers(97, 99, (40, substrings.CONTEXT)).astype(np.uint8)
    context[20:] = context[:20]
    context[25:, 60] ^= 1
    bucket = substrings.refine(context)
    strings = [[bytes(row[o : o + 50]) for o in range(bucket.shape[1])] for row in context]
    flat = [(s, int(b)) for row, ids in zip(strings, bucket, strict=True) for s, b in zip(row, ids, strict=True)]
    assert len(set(flat)) == len({s for s, _ in flat}) == len({b for _, b in flat})


def test_chunks_find_passages_and_resist_shifts(docs, texts, nothing):
    got = by_id(chunks.deduplicate(docs))
    for i in range(11, 18):
        assert sum(s.stop - s.start for s in got[i].removed_spans) > 250
    for i in (0, 1, 2, 3, 4, 8, 10, 18, 26):
        assert got[i].kept == texts[i] and got[i].removed_spans == []
    assert got[24].kept == "" and got[9].n_bytes == len(texts[9].encode())
    for i, t in texts.items():
        b = (t or "").encode()
        for s in reversed(got[i].removed_spans):
            b = b[: s.start] + b[s.stop :]
        assert (got[i].kept or "").encode() == b
    assert chunks.deduplicate(nothing).count() == 0


def test_chunks_remove_short_passages_to_their_edges(spark):
    rng = random.Random(5)
    rows, places = [], {}
    for k in range(0, 400, 2):
        passage, before = words(rng, 51), words(rng, 40) + " "
        rows += [(k, words(rng, 45) + "|" + passage + "|" + words(rng, 40)), (k + 1, before + passage + " " + words(rng, 40))]
        start = len(before.encode())
        places[k + 1] = start, start + len(passage.encode())
    got = by_id(chunks.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), min_run=100))
    spans = {i: [(s.start, s.stop) for s in got[i].removed_spans] for i in places}
    assert sum(spans[i] == [places[i]] for i in places) >= 0.95 * len(places)
    assert all(got[i - 1].removed_spans == [] for i in places)


def plain_chunks(t):
    """The chunks of a text by the rule, a byte at a time."""
    out, last, h = [], 0, 0
    start = lambda i: next((k for k in range(i, len(t)) if t[k] & 0xC0 != 0x80), len(t))
    for i, byte in enumerate(t, 1):
        h = (2 * h + int(chunks._GEAR[byte])) % (1 << 16)
        if i - last > chunks.LARGEST:
            out.append((last, start(last + chunks.LARGEST)))
            last = out[-1][1]
        if h >> 11 == 0 and i - last >= chunks.LEAST:
            out.append((last, start(i)))
            last = out[-1][1]
    return out + [(last, len(t))] * (last < len(t))


def alike(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def plain_removals(rows):
    """What each row (id, text) loses by the rule, and its repeated chunks."""
    reach = chunks.LARGEST + chunks.CHARACTER
    data = [(i, (t or "").encode()) for i, t in rows]
    cut = [plain_chunks(t) for _, t in data]
    holder = {}  # smallest document of each chunk
    for (i, t), found in zip(data, cut, strict=True):
        for a, b in found:
            holder[t[a:b]] = min(i, holder.get(t[a:b], i))
    out = []
    for (i, t), found in zip(data, cut, strict=True):
        seen, runs = {}, []
        for a, b in found:
            c = t[a:b]
            if holder[c] < i or c in seen:
                if runs and runs[-1][-1][1] == a:
                    runs[-1].append((a, b))
                else:
                    runs.append([(a, b)])
            seen.setdefault(c, (a, b))

        def places(a, b):
            c = t[a:b]  # noqa: B023
            if seen[c] != (a, b):  # noqa: B023
                yield t, *seen[c]  # noqa: B023
            if holder[c] < i:  # noqa: B023
                for (j, d), others in zip(data, cut, strict=True):
                    if j == holder[c]:
                        yield from [(d, x, y) for x, y in others if d[x:y] == c][:1]

        gone = bytearray(len(t))
        for run in runs:
            left = max((alike(t[max(0, run[0][0] - reach) : run[0][0]][::-1], d[max(0, x - reach) : x][::-1]) for d, x, _ in places(*run[0])), default=0)
            right = max((alike(t[run[-1][1] :][:reach], d[y:][:reach]) for d, _, y in places(*run[-1])), default=0)
            a, b = run[0][0] - left, run[-1][1] + right
            while t[a] & 0xC0 == 0x80:
                a += 1
            while b < len(t) and t[b] & 0xC0 == 0x80:
                b -= 1
            gone[a:b] = b"\1" * (b - a)
        out.append((i, bytes(x for x, g in zip(t, gone, strict=True) if not g), sum(map(len, runs)), len(found)))
    return out


@pytest.mark.parametrize("partitions", [1, 4, 7])
def test_chunks_match_brute_force_however_the_table_lies(spark, texts, partitions):
    """Ties too: passages that stand twice in a text or in several earlier ones, in unlike surroundings, monotonous texts, several texts of one id."""
    rng = random.Random(8)
    passages = [words(rng, n) for n in (12, 51, 90, 300)]
    rows = list(texts.items())
    rows += [(100 + k, " ".join(x for p in rng.choices(passages, k=3) for x in (words(rng, 30), p))) for k in range(40)]
    for k in range(40):  # of three that share a passage, two share what stands before it
        own, before = words(rng, 60), words(rng, 4)
        rows += [(200 + 3 * k, words(rng, 20) + " " + own), (201 + 3 * k, words(rng, 20) + f" {before} {own}"), (202 + 3 * k, words(rng, 20) + f" {before} {own} " + words(rng, 9))]
    rows += [(150, passages[3] + words(rng, 20)), (150, words(rng, 20) + passages[3]), (150, words(rng, 20) + passages[3]), (50, "aaaa" * 650), (51, "abab" * 400)]
    want = sorted(plain_removals(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = chunks.deduplicate(df.repartition(partitions) if partitions > 1 else df.coalesce(1)).collect()
    assert sorted((r.doc_id, (r.kept or "").encode(), r.n_repeated, r.n_chunks) for r in got) == want
    assert sum(len(t or "") for _, t in rows) - sum(len(k.decode()) for _, k, _, _ in want) > 10_000


def test_chunks_of_a_long_text_take_time_in_proportion(spark):
    rng = random.Random(12)
    lines = [words(rng, 12) for _ in range(2000)]
    texts = [" ".join(rng.choice(lines) + " " + words(rng, 2) for _ in range(n)) for n in (2_000, 20_000)]
    for t in texts:  # the first finds its own runs; quadratic work would take minutes for the second
        data = t.encode()
        ((_, h),) = chunks._hash_texts([data])
        start = time.perf_counter()
        found = list(chunks.edges_of(1, data, *chunks.chunk_digests(data, h, {}), [], chunks.LARGEST))
        assert time.perf_counter() - start < 20 and len(found) > 300
    (row,) = chunks.deduplicate(spark.createDataFrame([(1, texts[1])], "doc_id long, text string")).collect()
    assert row.n_bytes > 1_500_000 and len(row.kept) < 0.6 * row.n_bytes


def test_gear_hash_and_cuts_match_the_sequential_rule():
    data = random.Random(2).randbytes(5000)
    h, want = 0, []
    for byte in data:
        h = (2 * h + int(chunks._GEAR[byte])) % (1 << 16)
        want.append(h)
    assert chunks.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == want
    ends = chunks.cuts(b"ab" * 1000, np.ones(2000, np.uint16))
    assert ends[-1] == 2000 and max(np.diff([0, *ends])) <= chunks.LARGEST


@pytest.mark.parametrize("block", [neardup.BLOCK, 2])
def test_near_duplicates_match_brute_force(docs, texts, nothing, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)  # buckets of more members are dealt out as pairs of blocks
    got = by_id(neardup.near_duplicates(docs))

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    assert neardup.near_duplicates(nothing).count() == 0
    assert neardup.near_duplicates(docs).where("doc_id IS NULL AND kept").count() == 1


def test_a_group_whose_smallest_member_links_little_is_still_one(spark):
    rng = random.Random(5)
    base = words(rng, 150).split()

    def variant(k):  # neighbours in k are alike, the ends of the chain are not
        return " ".join(w if not k * 4 <= i < k * 4 + 12 else f"{w}{k}" for i, w in enumerate(base))

    rows = [(k, variant(k)) for k in range(30)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(146)} for i, t in rows}
    linked = {(i, j) for i in sets for j in sets if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    label = {i: i for i in sets}
    for _ in sets:
        label = {i: min(label[j] for j in sets if (i, j) in linked) for i in sets}
    assert {r.doc_id: r.component_id for r in got} == label


def test_posterior_bounds_keep_what_is_similar():
    bounds = neardup.least_matches(0.75)
    assert [n for n, _ in bounds] == [32, 64, 96, 128] and all(m < 0.75 * n for n, m in bounds)
    rng = np.random.default_rng(0)
    a = np.zeros((20_000, 128), np.uint32)
    assert len(neardup.survivors(a, (rng.random(a.shape) > 0.75).astype(np.uint32), bounds)) == len(a)
    assert len(neardup.survivors(a, (rng.random(a.shape) > 0.30).astype(np.uint32), bounds)) == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in neardup.components(edges).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_decontamination_matches_brute_force(spark, docs, texts, nothing):
    items = [(1, " ".join(texts[26].split()[5:40])), (2, "two THREE"), (3, None), (4, "!!"), (5, texts[8][1000:1400]), (1, "x"), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: found.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    assert all(decontaminate.count_words((t or "").encode()) == len(split(t)) for t in texts.values())
    windows = {}
    for item, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w and item else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    rows = decontaminate.decontaminate(docs, bench)
    got = by_id(rows)
    assert set(rows.columns) == {*docs.columns, *decontaminate.HITS.names}
    for i, t in texts.items():
        w, hit, names = split(t), set(), set()
        for win, owners in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    names |= owners
        assert (got[i].n_words, got[i]["items"]) == (len(w), sorted(names))
        assert {p for s in got[i].hit_spans for p in range(s.start, s.stop)} == hit
    assert [r["items"] for r in rows.where("doc_id IS NULL").collect()] == [got[18]["items"]]
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    assert all(r["items"] == [] for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("most", [1 << 17, 0])
def test_warc_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)  # broadcast, or filtered and shuffled
    same = "same \r\n\r\n WARC/1.1"
    pages = [(3, "http://a/\r\nX: y", same), (1, None, same), (2, "http://b", None), (4, "http://c", ""), (5, "u", "é" * 60_000), (3, "u", same), (None, "n", "other"), (6, "v", "alone"), (7, "p", "pair"), (8, "p", "pair")]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, digest string, payload string")
    path = scratch_path(spark, "test")
    warc.write_archive(df, path)
    records = warc.read_archive(spark, path, with_blocks=True).collect()
    rows = warc.join_revisits(warc.read_archive(spark, path)).collect()
    assert len(rows) == len(pages) == len({r.record_id for r in records})
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows}
    assert got == {(3, 18, "revisit", 1), (1, 18, "response", None), (2, 0, "response", None), (4, 0, "revisit", 2), (5, 120_000, "response", None), (None, 5, "response", None), (6, 5, "response", None), (7, 4, "response", None), (8, 4, "revisit", 7)}
    assert {r.payload_digest for r in rows if r.page_id == 1} == {base64.b32encode(hashlib.sha1(same.encode()).digest()).decode()}
    blocks = {r.page_id: bytes(r.block) for r in records}
    assert blocks[5] == ("é" * 60_000).encode() and blocks[3] == b""
    small = scratch_path(spark, "test")
    warc.write_archive(df, small, min_bytes=100)
    assert {r.record_type for r in warc.read_archive(spark, small).collect()} == {"response"}
    empty = scratch_path(spark, "test")
    warc.write_archive(df.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_warc_files_are_gzip_members_of_whole_records(spark):
    path = scratch_path(spark, "test")
    warc.write_archive(spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 300) for i in range(50)], "page_id long, url string, html string").coalesce(1), path)
    (content,) = [bytes(r.content) for r in spark.read.format("binaryFile").load(path + "/part-*").collect()]
    plain = gzip.decompress(content)
    assert plain.count(b"WARC/1.1\r\n") == 50 and plain.endswith(b"\r\n\r\n")
    starts = [m.start() for m in re.finditer(re.escape(warc._END), content)]
    assert len(starts) == 50 and gzip.decompress(content[starts[9] + len(warc._END) :]).startswith(b"WARC/1.1\r\n")


def test_url_rules(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("Example.com", "/en/7", "allow"), ("example.com", "/en/7", "allow"), ("b.org", "", "block"), ("b.org", "", "allow"), (None, "/", "block")], urls.RULES)
    cases = {
        "http://x.example.com/en/71?q#f": ("x.example.com", "/en/71", "example.com/en/7", "allow"),
        "HTTP://A.COM/en/8": ("a.com", "/en/8", "com/en/", "block"),
        "http://xcom/en/8": ("xcom", "/en/8", None, "allow"),
        "http://sub.b.org": ("sub.b.org", "", "b.org", "block"),
        "no scheme": ("", "", None, "allow"),
        "http://?/en/": ("", "", None, "allow"),
        "a://b://c/en/": ("b:", "//c/en/", None, "allow"),
        "http://" + "a." * 3000 + "com/en/": ("a." * 3000 + "com", "/en/", "com/en/", "block"),
    }
    rows = [(u, "x", "y") for u in cases] + [(None, "x", "y"), ("no scheme", "x", "y")]
    pages = spark.createDataFrame(rows, "url string, verdict string, key string")
    got = urls.judge(pages, rules).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases.get(r.url, ("", "", None, "allow"))
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("limits", [(1 << 20, 1 << 17), (0, 0)])
def test_urls_match_brute_force_on_either_side_of_the_limits(spark, monkeypatch, limits):
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", limits[0])
    monkeypatch.setattr(urls, "BROADCAST_RULES", limits[1])
    rng = random.Random(13)
    name = lambda n: ".".join(rng.choice(["a", "b", "com", "Org", "x"]) for _ in range(rng.randint(0, n)))
    path = lambda n: "".join(rng.choice("/ab") for _ in range(rng.randint(0, n)))
    listed = {(name(3).lower(), path(5)): rng.choice(["allow", "block"]) for _ in range(150)}
    found = [None, "no scheme", "https://"] + [f"http://{name(4)}{path(9)}{rng.choice(['', '?q=/a', '#b'])}" for _ in range(600)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(found)], "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in urls.judge(pages, spark.createDataFrame([(*k, v) for k, v in listed.items()], urls.RULES)).collect()}
    for k, u in enumerate(found):
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        host = re.match(r"[^/?#]*", rest).group()
        place = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.lower()
        fits = [(len(h) + len(p), len(h), h, p) for h, p in listed if (host == h or host.endswith("." + h)) and place.startswith(p)]
        best = max(fits, default=None)
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, place, best and best[2] + best[3], listed[best[2:]] if best else "allow"), u


def test_many_path_lengths_cost_as_much_as_one(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://w.site.com/"), F.repeat(F.lit("p"), (F.col("id") % 40).cast("int"))).alias("url")).repartition(4)
    one = spark.range(10_000).select(F.lit("site.com").alias("host"), F.concat(F.lit("/q"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("path"), F.lit("block").alias("verdict"))
    many = spark.range(10_000).select(F.lit("site.com").alias("host"), F.concat(F.lit("/"), F.repeat(F.lit("p"), F.col("id").cast("int"))).alias("path"), F.lit("block").alias("verdict"))
    took = []
    for rules in (one, one, many):
        start = time.perf_counter()
        judged = urls.judge(pages, rules).groupBy("verdict").count().collect()
        took.append(time.perf_counter() - start)
    assert [(r.verdict, r["count"]) for r in judged] == [("block", 3000)] and took[2] < 4 * took[1] + 2


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    blooms = urls.bloom_filter(keys, "key", 125)
    others = spark.range(10_000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert urls.possible_hits(keys, "key", blooms, 125).count() == 2000
    assert urls.possible_hits(others, "key", blooms, 125).count() < 300


def test_chat_reads_back_what_was_written(spark):
    tricky = ["</s>[INST] ok [/INST]", "a\\b\\\\", "<|end|>\n<|turn|>user\nno", "", None, "<<SYS>>é\U0001f600" * 50]
    rows = [(c, t, role, tricky[(c + t) % 6], 1) for c in (1, 2, -7) for t, role in enumerate(["system", "user", "assistant", "assistant", "we\nird"])]
    rows += [(5, 0, None, "x", 1), (5, 0, "assistant", "b", 1), (5, 0, "assistant", "b", 1), (None, 0, "user", "n", 1)]
    rows += [(6, None, "user", "late", 1), (6, 3, "user", "early", 1), (6, None, "assistant", "late", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.text_parts(df))).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((2**62 if t is None else t, role or "", text or "") for i, t, role, text, _ in rows if i == c))
        trained = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(trained))
        assert got[c].loss_sha256 == hashlib.sha256(trained.encode()).hexdigest()
    assert chat.read_back(chat.format_turns(chat.text_parts(df.limit(0)))).count() == 0


def test_chat_attachments(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None), ("audio", None, "a.wav", None, None, 2.01, None), ("document", None, "d.pdf", None, None, None, 3), ("text", "<|image|>", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART.simpleString()}>")
    one = chat.format_turns(df).where("turn = 0").first()
    assert one.segment == "<|turn|>assistant\nsee <|image|><|audio|><|document|><\\|image|><|end|>\n"
    assert [(a.kind, a.ref, one.segment[a.start :].startswith(chat.PLACEHOLDERS[a.kind]), a.tokens) for a in one.attachments] == [("image", "i.png", True, 3), ("audio", "a.wav", True, 51), ("document", "d.pdf", True, 1536)]
    assert one.expanded_tokens == 1590 and "".join(chat.unescape(one.segment[s.start : s.stop]) for s in one.loss_spans) == "see <|image|>"


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 12)).astype(np.float32)
    x[300:700] = x[0]
    rows = [(i, v.tolist(), "q") for i, v in enumerate(x)] + [(1200, None, "q"), (1300, [0.0] * 12, "q"), (1400, [float("nan")] * 12, "q"), (1500, [None] * 12, "q"), (0, x[0].tolist(), "q"), (None, x[1].tolist(), "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string").repartition(4)
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, sample_rows=512, leaf_rows=32).toPandas()
    hits = 0
    for q in range(0, 1200, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(1200), d)) if i != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and np.allclose(mine.score, d[mine.vec_id], atol=1e-12)
        hits += len(set(want) & set(mine.vec_id))
        if q in (0, 300, 600):
            assert mine.vec_id.tolist() == want
    assert hits >= 0.9 * 120 and got.query_id.nunique() == 12
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.where("vec_id IN (1, 2, 3)")).groupBy("query_id").count().where("count = 2").count() == 3


def test_large_leaves_are_dealt_in_pieces(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(400, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    search = lambda: sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") % 100 == 0, sample_rows=64, leaf_rows=32).collect()))
    whole = search()
    monkeypatch.setattr(neighbours, "PIECE_ROWS", 16)
    assert search() == whole and len(whole) == 40


def test_results_of_a_key_merge_to_its_best(spark):
    keys, ids, scores = np.array([1, 1, 1, 1, 2]), np.array([9, 9, 7, 8, 9]), np.array([0.5, 0.2, 0.2, 0.1, 3.0])
    assert [a.tolist() for a in neighbours.best_of(keys, ids, scores, 2)] == [[1, 1, 2], [8, 7, 9], [0.1, 0.2, 3.0]]
    twice = neighbours.nearest_of(np.zeros((1, 2)), np.array([[1.0, 0], [2, 0], [3, 0]]), np.array([5, 5, 6]), 2)
    assert [a.tolist() for a in twice] == [[0, 0], [5, 6], [1.0, 3.0]]


def test_quality_is_learned_from_what_is_not_held_out(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        t, good = words(rng, rng.randint(5, 80)), i % 3 > 0
        rows.append((i, t if good else " ".join(w.upper() + "!!" for w in t.split()), "x"))
        labels.append((i, int(good)))
    docs = spark.createDataFrame([*rows, (600, None, "x"), (601, "", "x"), (601, "", "x"), (None, "a", "x")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (600, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, marks)).withColumn("out", quality.held_out("doc_id")).collect()
    held = [r for r in got if r.out and r.doc_id < 600]
    assert len(got) == 604 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    blank = quality.score(docs, quality.train(docs, marks.limit(0)))
    assert {r.score for r in blank.collect()} == {0.5} and quality.score(docs.limit(0), quality.fit(np.zeros((0, 15)), np.zeros(0))).count() == 0


def test_gam_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=20)
    assert (0, 1) in model.pairs and ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_bpe_matches_tiktoken(docs, texts, nothing):
    import public_tokenizers

    plain = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = by_id(bpe.decode(bpe.encode(docs)))
    for i, t in texts.items():
        assert got[i].token_ids == plain.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()
    assert bpe.decode(bpe.encode(nothing)).count() == 0
    long = ("ab" * 5000 + "  \n " * 900 + words(random.Random(1), 9000)) * 2
    assert bpe.encode_text(long, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).tolist() == plain.encode_ordinary(long)
