"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few numeric features. Every feature is binned at quantiles
of the training rows and has a lookup table with a value for each bin; the
table is the sum of many shallow trees of three splits, fitted in turns
(cyclically) to the gradient of the log loss, each with a small step, so no
feature takes another's share. The pairs whose joint bins explain most of the
remaining gradient then get tables of two dimensions in the same way. A score
is the sum of looked-up values through the logistic function.

The model is fitted on at most MAX_TRAINING_ROWS labelled rows, those with the
smallest hash of their doc_id; all else is over all rows.

Defined results: null texts are empty; an empty text has features (zeros) and
gets a score like any other; labels that are null are left out; a doc_id
labelled several times counts several times; without training rows every score
is 0.5; repeated rows are scored alike; extra columns stay, columns of the
names that are added are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import schema_of, tidy

MAX_TRAINING_ROWS = 20_000

FEATURES = [
    "log_bytes",
    "log_words",
    "word_length",
    "distinct_words",
    "repeated_words",
    "upper_bytes",
    "digit_bytes",
    "symbol_bytes",
    "exclamations",
    "pipes",
    "stops",
    "commas",
    "line_length",
    "distinct_lines",
    "longest_word",
]


def _table(chars: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(chars)] = True
    return mask


_CLASSES = np.stack([_table(bytes(range(0x41, 0x5B))), _table(b"0123456789"), _table(b"#$%&*@^~<>{}[]\\_=+"), _table(b"!?"), _table(b"|"), _table(b"."), _table(b",;:")]).T.astype(np.float64)


def text_features(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(FEATURES)
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = (counts @ _CLASSES / len(data)).tolist()
    n = max(1, len(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(len(data))),
        float(np.log1p(len(words))),
        (len(data) - len(words)) / n,
        len(set(words)) / n,
        again / n,
        *shares,
        len(data) / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
        float(max(map(len, words), default=0)),
    ]


@dataclass
class Model:
    """Bin edges, a table for each feature and tables for some pairs of features (on coarser edges)."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for (a, b), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, splits: int = 3) -> np.ndarray:
    """The values that a tree of so many splits gives to each bin, from the bins' sums of gradient and curvature."""
    parts = [(0, len(g))]
    for _ in range(splits):
        best = (1e-6, None, 0)
        for i, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gains = _gain(gl, hl) + _gain(gt - gl, ht - hl) - _gain(gt, ht)
            k = int(np.argmax(gains))
            if gains[k] > best[0]:
                best = (gains[k], i, a + k + 1)
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _shallow_tree_2d(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A cut of the first feature and one of the second on either side of it, or the other way round."""
    best, out = -1.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(gg)):
            made, gain = np.zeros_like(gg), 0.0
            for side in (slice(0, cut), slice(cut, len(gg))):
                gs, hs = gg[side].sum(0), hh[side].sum(0)
                values = _shallow_tree(gs, hs, 1)
                made[side] = values
                gain += float((values * gs).sum() - 0.5 * (values * values * (hs + 1e-9)).sum())
            if gain > best:
                best, out = gain, made.T if turned else made
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 120, pair_rounds: int = 30, n_pairs: int = 5, step: float = 0.1) -> Model:
    """x: rows by features, y: 0 or 1."""
    if not len(y):
        return Model()
    prior = (y.sum() + 1) / (len(y) + 2)
    m = Model(float(np.log(prior / (1 - prior))))
    n = x.shape[1]
    m.edges = [_quantile_edges(x[:, j], bins) for j in range(n)]
    m.coarse = [_quantile_edges(x[:, j], coarse_bins) for j in range(n)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    fine = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.edges)]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.coarse)]
    total = np.full(len(y), m.intercept)

    def sums(cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return np.bincount(cells, y - p, size), np.bincount(cells, p * (1 - p), size)

    for _ in range(rounds):
        for j in range(n):
            tree = step * _shallow_tree(*sums(fine[j], len(m.tables[j])))
            m.tables[j] += tree
            total += tree[fine[j]]

    shapes = [len(e) + 1 for e in m.coarse]
    cells = {(a, b): rough[a] * shapes[b] + rough[b] for a in range(n) for b in range(a + 1, n)}
    strength = {p: float(_gain(*sums(c, shapes[p[0]] * shapes[p[1]])).sum()) for p, c in cells.items()}
    chosen = sorted(strength, key=lambda p: (-strength[p], p))[:n_pairs]
    m.pairs = {p: np.zeros((shapes[p[0]], shapes[p[1]])) for p in chosen}
    for _ in range(pair_rounds):
        for p in chosen:
            g, h = sums(cells[p], m.pairs[p].size)
            tree = step * _shallow_tree_2d(g.reshape(m.pairs[p].shape), h.reshape(m.pairs[p].shape))
            m.pairs[p] += tree
            total += tree.ravel()[cells[p]]
    return m


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def _features(batch: pa.RecordBatch, text_col: str) -> np.ndarray:
    texts = batch.column(batch.schema.get_field_index(text_col))
    return np.array([text_features(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Fits a model on the labelled documents that are not held out: at most max_rows labels, and one row for each id and label."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    sample = usable.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    # not over max_rows rows of two numbers
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id").select("__id", "__text", "__label")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.ListArray.from_arrays(np.arange(0, batch.num_rows * len(FEATURES) + 1, len(FEATURES), dtype=np.int32), _features(batch, "__text").ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), values], names=["id", "label", "x"])

    # rows that share an id are one row of training for each of its labels, so no more come to the driver than labels were drawn
    found = rows.mapInArrow(run, "id long, label int, x array<double>").groupBy("id", "label").agg(F.min("x").alias("x")).toPandas()
    found = found.assign(first=[tuple(v) for v in found.x]).sort_values(["id", "label", "first"], kind="stable")
    x = np.array(found.x.tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, (found.label.to_numpy() > 0).astype(float))


SCORED = schema_of(score="double", predicted="int")


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from a score of 0.5)."""
    kept = [c for c in docs.columns if c not in SCORED.names]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_features(batch, text_col))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*kept, *SCORED.names])

    return docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], *SCORED.fields]))
