"""Hard negatives by norm-bucketed search for largest inner products.

Candidates are sorted by norm into buckets (edges: approximate quantiles of the
norms) and, within these, by groups of labels; a cell is one bucket of one group,
dealt to several tasks where it holds more than PIECE_ROWS. An anchor's window is
the range of scores that its list takes. A cell can be left out for an anchor when
the Cauchy-Schwarz bound (the anchor's norm times the cell's largest) is under the
window's lower limit or under the kth score that is known so far. A search has two
rounds: the cells of the largest norms, which give running kth scores, then those
of the others that the bound allows. Within a task the same bound ends the walk
down a cell's blocks, which are sorted by norm.

Positives are searched in the cells of the anchor's group of labels (window: all
scores), negatives in all cells, one window for each different score among the
anchor's positives. Queries meet cells in blocks of BLOCK_QUERIES by BLOCK_ROWS,
and only lists of k rows leave a task.

Equal vectors of one label are indexed by their `k` smallest ids alone (no list
can use more), and equal anchors are searched once, so a vector that fills a third
of the table costs no more than another.

Scores are whole numbers and exact: products are made in doubles where they stay
under 2^53, else in 64-bit integers.

Defined results: rows with a null id or label, a null or empty vector, a null or
non-finite component, a vector whose scaled squared length is 2^62 or more (its
scores need not fit 64 bits), or a vector of another length than the commonest
(of several, the shortest) take no part; repeated rows count once; of rows that
share an id, the first by label and vector counts; equal scores go to the smaller
id; an anchor without positives, and a positive without negatives, give no rows;
where the positive's score is under zero its window is empty; other columns are
not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import join_hot, materialize, schema_of, tidy

#: Candidates of a norm bucket, the most buckets, groups of labels, and candidates of a cell that one task holds.
BUCKET_ROWS, MOST_BUCKETS, GROUPS, PIECE_ROWS = 32_768, 256, 16, 65_536
#: Rows and anchors multiplied at once, and results that a task holds before it merges them.
BLOCK_ROWS, BLOCK_QUERIES, MERGED_ROWS = 2048, 128, 131_072
#: The first round takes the buckets of the largest norms: one in so many.
FIRST_SHARE = 8
#: Windows of an anchor: the different scores of its positives, itself among them.
POSITIVES, NEGATIVES = 5, 10
WINDOWS = POSITIVES + 1
_LOW, _HIGH = -(1 << 62), 1 << 62

CANDIDATE = schema_of(bucket="int", group="int", label="long", norm="double", id="long", vector="binary")
#: limits: for each window its lower and upper limit and the kth score known, as packed longs.
QUERY = schema_of(key="long", label="long", norm="double", vector="binary", limits="binary")
FOUND = schema_of(key="long", window="int", id="long", score="long")
_PLACED = schema_of(cell="long", kind="int", order="double", id="long", label="long", vector="binary", limits="binary")


def scaled(vectors: DataFrame, anchors: Column, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, label, vector (whole numbers, as doubles), asked (1 for anchors) of the rows that take part."""
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where((F.size(vector_col) > 0) & finite)
    rows = rows.where(F.forall(F.col(vector_col), lambda x: F.abs(x.cast("double")) * scale < float(1 << 40)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("vector"), F.coalesce(anchors, F.lit(False)).cast("long").alias("asked"))
    return rows.where(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) < float(_HIGH))


def edges_of(norms: DataFrame, rows: int) -> list[float]:
    """Norms that divide the rows into about equal buckets, smallest first."""
    buckets = min(MOST_BUCKETS, -(-rows // BUCKET_ROWS))
    if buckets < 2:
        return []
    found = norms.approxQuantile("norm", [k / buckets for k in range(1, buckets)], 0.1 / buckets)
    return sorted(set(found))


def group_of(label: np.ndarray) -> np.ndarray:
    return (label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % GROUPS


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _matrix(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def packed_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows (names..., vector) with the vector as packed longs, and its norm (rounded up)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                norm = np.sqrt((x * x).sum(axis=1)) * (1 + 1e-12)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(norm), _packed(x.astype(np.int64))], names=[*names, "norm", "vector"])

    return rows.mapInArrow(run, schema_of(**dict.fromkeys(names, "long"), norm="double", vector="binary"))


@dataclass
class Cells:
    """What is known of each cell: its largest norm and its pieces. At most GROUPS * MOST_BUCKETS cells, of any table."""

    edges: list[float]
    top: np.ndarray  # buckets, groups: largest norm, -1 where empty
    pieces: np.ndarray

    def bucket(self, norm: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, norm, side="right") if self.edges else np.zeros(len(norm), np.int64)

    @property
    def first(self) -> int:
        """The lowest bucket of the first round."""
        return len(self.edges) + 1 - max(1, (len(self.edges) + 1) // FIRST_SHARE)


def cells_of(candidates: DataFrame) -> Cells:
    """candidates: label, norm. What comes to the driver is a row for each cell."""
    edges = edges_of(candidates.select("norm"), candidates.count())
    cells = Cells(edges, np.full((len(edges) + 1, GROUPS), -1.0), np.zeros((len(edges) + 1, GROUPS), np.int64))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, n = np.full(cells.top.shape, -1.0), np.zeros(cells.top.shape, np.int64)
        for batch in batches:
            norm, group = batch.column("norm").to_numpy(), group_of(batch.column("label").to_numpy())
            np.maximum.at(top, (cells.bucket(norm), group), norm)
            np.add.at(n, (cells.bucket(norm), group), 1)
        at = np.flatnonzero(n.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(top.ravel()[at]), pa.array(n.ravel()[at])], names=["cell", "top", "n"])

    told = candidates.select("label", "norm").mapInArrow(run, schema_of(cell="long", top="double", n="long"))
    for row in told.groupBy("cell").agg(F.max("top").alias("top"), F.sum("n").alias("n")).collect():
        cells.top.ravel()[row.cell], cells.pieces.ravel()[row.cell] = row.top, -(-row.n // PIECE_ROWS)
    return cells


def place_candidates(candidates: DataFrame, cells: Cells, low: int, high: int) -> DataFrame:
    """The candidates of the buckets low..high-1 with their cells."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm, label, ids = (batch.column(c).to_numpy() for c in ("norm", "label", "id"))
            bucket, group = cells.bucket(norm), group_of(label)
            piece = (ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % np.maximum(1, cells.pieces[bucket, group])
            at = np.flatnonzero((bucket >= low) & (bucket < high))
            cell = ((bucket * GROUPS + group) << 24 | piece)[at]
            rows = batch.take(pa.array(at))
            columns = [pa.array(cell), pa.array(np.zeros(len(at), np.int32)), pa.array(-norm[at]), rows.column("id"), rows.column("label"), rows.column("vector"), pa.nulls(len(at), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=_PLACED.names)

    return candidates.select("id", "label", "norm", "vector").mapInArrow(run, _PLACED)


def place_queries(queries: DataFrame, cells: Cells, low: int, high: int, own_group: bool) -> DataFrame:
    """Each query once for each piece of the cells of buckets low..high-1 that its bound allows."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 16) // max(1, int(cells.pieces[low:high].sum())))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                norm, label = batch.column("norm").to_numpy(), batch.column("label").to_numpy()
                limits = _matrix(batch.column("limits")).reshape(batch.num_rows, -1, 3)
                need = np.maximum(limits[:, :, 0], limits[:, :, 2]).min(axis=1).astype(np.float64)
                may = (cells.pieces[None, low:high] > 0) & (norm[:, None, None] * cells.top[None, low:high] * (1 + 1e-9) >= need[:, None, None])
                if own_group:
                    may &= (group_of(label)[:, None] == np.arange(GROUPS)[None, :])[:, None, :]
                of, bucket, group = np.nonzero(may)
                times = cells.pieces[bucket + low, group]
                piece = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                of, cell = np.repeat(of, times), np.repeat(((bucket + low) * GROUPS + group) << 24, times) | piece
                rows = batch.take(pa.array(of))
                columns = [pa.array(cell), pa.array(np.ones(len(of), np.int32)), rows.column("norm"), rows.column("key"), rows.column("label"), rows.column("vector"), rows.column("limits")]
                yield pa.RecordBatch.from_arrays(columns, names=_PLACED.names)

    return queries.select("key", "label", "norm", "vector", "limits").mapInArrow(run, _PLACED)


def products(q: np.ndarray, x: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of whole numbers."""
    if bound < float(1 << 52):
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.stack([(x * row).sum(axis=1) for row in q]) if len(q) else np.zeros((0, len(x)), np.int64)


def best_of(keys: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of each key with the highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores, keys))
    keys, ids, scores = keys[order], ids[order], scores[order]
    place = np.arange(len(keys)) - np.searchsorted(keys, keys)
    return keys[place < k], ids[place < k], scores[place < k]


class _Cell:
    """The candidates of one piece of a cell, by falling norm."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, norms: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.labels, self.norms, self.vectors = ids, labels, norms, vectors

    def search(self, keys: np.ndarray, labels: np.ndarray, norms: np.ndarray, vectors: np.ndarray, limits: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
        """key * windows + window, id, score of the k best of each query's windows. limits: query, window, (low, high, kth known)."""
        windows = limits.shape[1]
        need = np.maximum(limits[:, :, 0], limits[:, :, 2])
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        slots = keys[:, None] * windows + np.arange(windows)
        for at in range(0, len(self.ids), BLOCK_ROWS):
            reach = norms * self.norms[at] * (1 + 1e-9)
            alive = np.flatnonzero((reach[:, None] >= need).any(axis=1))
            if not len(alive):
                break
            x = self.vectors[at : at + BLOCK_ROWS]
            scores = products(vectors[alive], x, float(reach[alive].max()))
            fits = (labels[alive][:, None] == self.labels[at : at + BLOCK_ROWS][None, :]) == same
            new = [found]
            for w in range(windows):
                open_to = fits & (scores >= need[alive, w][:, None]) & (scores <= limits[alive, w, 1][:, None])
                if scores.shape[1] > k:
                    # only what reaches the kth of the block (and its ties)
                    best = np.where(open_to, scores, _LOW)
                    open_to &= scores >= np.partition(best, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
                of, near = np.nonzero(open_to)
                new.append((slots[alive[of], w], self.ids[at + near], scores[of, near]))
            found = best_of(*(np.concatenate(c) for c in zip(*new, strict=True)), k)
            full = np.flatnonzero(np.bincount(np.searchsorted(found[0], found[0])) == k)
            need.ravel()[np.searchsorted(slots.ravel(), found[0][full])] = np.maximum(need.ravel()[np.searchsorted(slots.ravel(), found[0][full])], found[2][full + k - 1])
        return found


def _search_cells(same: bool, windows: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, kind and order: candidates, then the queries that came to their cell."""
    now, parts, cell, held, n_held = None, [], None, [], 0

    def sent(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0] // windows), pa.array((rows[0] % windows).astype(np.int32)), pa.array(rows[1]), pa.array(rows[2])], names=FOUND.names)

    for batch in batches:
        cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(cells)], strict=True):
            if a == b:
                continue
            if cells[a] != now:
                now, parts, cell = cells[a], [], None
            rows = batch.slice(a, b - a)
            own = (rows.column("id").to_numpy(), rows.column("label").to_numpy(), rows.column("order").to_numpy(), _matrix(rows.column("vector")))
            if kinds[a] == 0:
                parts.append(own)
                continue
            if cell is None and parts:
                ids, labels, order, vectors = (np.concatenate(c) for c in zip(*parts, strict=True))
                cell, parts = _Cell(ids, labels, -order, vectors), []
            if cell is None:
                continue
            limits = _matrix(rows.column("limits")).reshape(b - a, windows, 3)
            for at in range(0, b - a, BLOCK_QUERIES):
                some = slice(at, at + BLOCK_QUERIES)
                order = np.argsort(own[0][some], kind="stable")
                held.append(cell.search(*(c[some][order] for c in own), limits[some][order], same, k))
                n_held += len(held[-1][0])
            if n_held > MERGED_ROWS:
                best = best_of(*(np.concatenate(c) for c in zip(*held, strict=True)), k)
                held, n_held = [best], len(best[0])
                if n_held > MERGED_ROWS // 2:
                    yield sent(best)
                    held, n_held = [], 0
    if n_held:
        yield sent(best_of(*(np.concatenate(c) for c in zip(*held, strict=True)), k))


def _kept(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def search(queries: DataFrame, candidates: DataFrame, cells: Cells, same: bool, windows: int, k: int) -> DataFrame:
    """The k best candidates (key, window, id, score) in each window of each query, of the same or of other labels."""

    def round_of(asked: DataFrame, low: int, high: int) -> DataFrame:
        both = place_candidates(candidates, cells, low, high).unionByName(place_queries(asked, cells, low, high, own_group=same))
        dealt = both.repartition("cell").sortWithinPartitions("cell", "kind", "order")
        return dealt.mapInArrow(tidy(lambda it: _search_cells(same, windows, k, it)), FOUND)

    first = cells.first
    found = _kept(round_of(queries, first, len(cells.edges) + 1), k)
    if not first:
        return found
    found = materialize(found, "first-found")
    # the kth score of each window that is full
    full = found.groupBy("key", "window").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    known = full.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("kth"))

    @tidy
    def raise_limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limits = _matrix(batch.column("limits")).reshape(batch.num_rows, windows, 3).copy()
            for at, kth in enumerate(batch.column("kth").to_pylist()):
                for w, score in kth or ():
                    limits[at, w, 2] = score
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in QUERY.names[:-1]), _packed(limits)], names=QUERY.names)

    raised = queries.join(known, "key", "left").select(*QUERY.names[:-1], "limits", "kth").mapInArrow(raise_limits, QUERY)
    return _kept(found.unionByName(round_of(raised, 0, first)), k)


def with_limits(queries: DataFrame, limits: DataFrame | None, windows: int) -> DataFrame:
    """queries (key, label, norm, vector) with their windows: limits (key, window, low, high), or one window of all scores."""
    empty = np.tile(np.array([_HIGH, _LOW, _HIGH], np.int64), (windows, 1))
    if limits is None:
        whole = np.array([[_LOW, _HIGH, _LOW]], np.int64).tobytes()
        return queries.withColumn("limits", F.lit(whole))
    listed = limits.groupBy("key").agg(F.collect_list(F.struct("window", "low", "high")).alias("w"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for given in batch.column("w").to_pylist():
                own = empty.copy()
                for w in given:
                    own[w["window"]] = (w["low"], w["high"], _LOW)
                packed.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in QUERY.names[:-1]), pa.array(packed, pa.binary())], names=QUERY.names)

    return queries.join(listed, "key").select(*QUERY.names[:-1], "w").mapInArrow(run, QUERY)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column | None = None,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: int = 256,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = 30,
    most: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    anchors: which rows of the table are anchors (a condition on it); by default all. A positive's negatives score between
    `least` and `most` hundredths of its own score.
    """
    rows = materialize(scaled(vectors, F.lit(True) if anchors is None else anchors, id_col, label_col, vector_col, scale), "scaled")
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
    rows = rows.where(F.size("vector") == (lengths["length"] if lengths else 0))
    k = max(positives + 1, negatives)
    # an id's first row, then of equal vectors of one label the k smallest ids
    single = rows.groupBy("id").agg(F.min(F.struct("label", "vector", "asked")).alias("row")).select("id", "row.*")
    alike = Window.partitionBy("label", "vector").orderBy("id")
    numbered = materialize(packed_rows(single, ["id", "label", "asked"]), "rows")
    listed = numbered.withColumn("__n", F.row_number().over(alike)).where(F.col("__n") <= k).drop("__n")
    candidates = materialize(listed, "candidates")
    cells = cells_of(candidates)

    asked = numbered.where("asked = 1")
    classes = materialize(asked.groupBy("label", "vector").agg(F.min("id").alias("key"), F.first("norm").alias("norm")), "anchors")
    members = materialize(join_hot(asked.select("id", "label", "vector"), classes.select("label", "vector", "key"), ["label", "vector"]).select("id", "key"), "members")
    queries = classes.select("key", "label", "norm", "vector")

    near = materialize(search(with_limits(queries, None, 1), candidates, cells, True, 1, positives + 1), "positives")
    order = Window.partitionBy("key").orderBy(F.desc("score"))
    scores = near.select("key", "score").distinct().withColumn("window", F.row_number().over(order) - 1)
    # of whole numbers and without leaving 64 bits: score = 100 * (score div 100) + remainder, floored
    hundreds, rest = "((score - pmod(score, 100)) div 100)", "pmod(score, 100)"
    low, high = F.expr(f"{least} * {hundreds} + ({least} * {rest} + 99) div 100"), F.expr(f"{most} * {hundreds} + ({most} * {rest}) div 100")
    limits = scores.select("key", "window", "score", low.alias("low"), high.alias("high")).where("low <= high")
    limits = materialize(limits, "windows")
    asked_for = with_limits(queries, limits.select("key", "window", "low", "high"), positives + 1)
    far = search(asked_for, candidates, cells, False, positives + 1, negatives)
    lists = far.groupBy("key", "window").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))).alias("list"))
    lists = lists.join(limits.select("key", "window", "score"), ["key", "window"]).select("key", F.col("score").alias("positive_score"), "list")

    ranked = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))).alias("near"))
    own = join_hot(members, ranked, ["key"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, positives)
    own = own.select(F.col("id").alias("anchor_id"), "key", F.explode(others).alias("p")).select("anchor_id", "key", F.col("p.id").alias("positive_id"), (-F.col("p.down")).alias("positive_score"))
    paired = join_hot(own, lists, ["key", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("list"))
    return paired.select("anchor_id", "positive_id", (F.col("pos") + 1).alias("rank"), F.col("col.id").alias("negative_id"), "positive_score", (-F.col("col.down")).alias("negative_score"))

