"""Reading pages: HTML text units and table cells, word boxes, quotes, and the units that amounts are stated in."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: elements whose text is a unit
UNIT_TAGS = ["p", "td", "th", "li", "h1", "h2", "h3", "h4", "h5", "h6", "caption", "dt", "dd"]
# fixed values: scales of amounts in crores
SCALES = {"crore": "1", "lakh": "0.01", "lac": "0.01", "million": "0.1", "billion": "100", "thousand": "0.0001"}
# fixed value: a page with less text than this has to be read optically
LEAST_TEXT = 25
# fixed values: words whose tops differ by less lie on one line, and a line may begin again this much to the left
LINE_GAP, LINE_BACK = 3, 1

#: Units that a task sends on at once.
BATCH_UNITS = 5_000

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Tags as most pages have them: names with plainly quoted attributes. Pages with any other "<", or with elements whose content is no markup, are left to the parser.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z][a-zA-Z0-9-]*="[^"<>]*")*)\s*>""")
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}
#: An opening tag ends an open one of these, up to the nearest container named second.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "p": ({"p"}, {"div", "td", "th", "li", "body", "section"})}


class _Units(HTMLParser):
    """Collects the text once; an element is a range of it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.length = [], 0
        self.open: list[tuple[str, str, int, dict[str, int], int]] = [("", "", 0, {}, -1)]
        self.ranges: list[list] = []

    def _begin(self, tag: str) -> str:
        """The path of an element that begins here, after what it ends."""
        _, path, _, counts, _ = self.open[-1]
        # where such an element stood already, another ends nothing
        if tag not in counts and tag in _ENDS:
            ends, within = _ENDS[tag]
            at = len(self.open)
            for held in reversed(self.open):
                at -= 1
                if held[0] in within:
                    break
                if held[0] in ends:
                    self._close(at)
                    _, path, _, counts, _ = self.open[-1]
                    break
        counts[tag] = count = counts.get(tag, 0) + 1
        return f"{path}/{tag}[{count}]"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        here, number = self._begin(tag), -1
        if tag in UNIT_TAGS:
            number = len(self.ranges)
            self.ranges.append([here, tag, self.length, None])
        if tag not in _VOID:
            self.open.append((tag, here, self.length, {}, number))

    def leaf(self, tag: str, data: str) -> None:
        """An element that holds this text and no other: opened and closed at once."""
        here, start = self._begin(tag), self.length
        if data:
            self.handle_data(data)
        if tag in UNIT_TAGS:
            self.ranges.append([here, tag, start, self.length])

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                self._close(at)
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        self.length += len(data)

    def _close(self, at: int) -> None:
        while len(self.open) > at:
            number = self.open.pop()[4]
            if number >= 0:
                self.ranges[number][3] = self.length


def _fed(reader: _Units, html: str) -> None:
    """The page's tags and texts, handed to the reader: cut by one expression where that says the same as the parser, which takes several times as long."""
    parts = _TAG.split(html)
    plain = parts[0::4]
    closing, tags = parts[1::4], [t.lower() for t in parts[2::4]]
    # a closing tag has no attributes
    if any("<" in p for p in plain) or not _RAW.isdisjoint(tags) or any(a and b for a, b in zip(closing, parts[3::4], strict=True)):
        reader.feed(html)
        reader.close()
        return
    texts = [unescape(t) if "&" in t else t for t in plain]
    if texts[0]:
        reader.handle_data(texts[0])
    # most elements hold only a text, and are closed by the next tag
    leaf = [not c and d and t == u and t not in _VOID for c, d, t, u in zip(closing, closing[1:], tags, tags[1:], strict=False)] + [False]
    done = False
    for is_leaf, closes, tag, text in zip(leaf, closing, tags, texts[1:], strict=False):
        if is_leaf:
            reader.leaf(tag, text)
            done = True
            continue
        if done:
            done = False
        elif closes:
            reader.handle_endtag(tag)
        else:
            reader.handle_starttag(tag, [])
        if text:
            reader.handle_data(text)


def units_of(html: str | None) -> list[tuple[str, str, str]]:
    """(node path, tag, text) of each unit in document order, nested ones both; blank units are left out."""
    reader = _Units()
    _fed(reader, html or "")
    whole = "".join(reader.text)
    found = [(path, tag, whole[start : len(whole) if end is None else end]) for path, tag, start, end in reader.ranges]
    return [f for f in found if f[2].strip()]


def html_units(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """One row a text unit: id, unit_no, node_path, tag, text. Paths number every step among its like-named siblings."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            held: list[tuple] = []
            for key, html in rows:
                held += [(key, n, *unit) for n, unit in enumerate(units_of(html))]
                if len(held) >= BATCH_UNITS:
                    yield packed(held, batch.schema.field(0).type)
                    held = []
            if held:
                yield packed(held, batch.schema.field(0).type)

    def packed(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = (kind, pa.int32(), pa.string(), pa.string(), pa.string())
        arrays = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [id_col, "unit_no", "node_path", "tag", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(read, f"{id_col} {kind}, unit_no int, node_path string, tag string, text string")


def table_cells(units: DataFrame, id_col: str) -> DataFrame:
    """The cells of each table: id, table_path, row_no, col_no (from 1), text with white space collapsed."""
    path = F.col("node_path")
    cells = units.where(F.col("tag").isin("td", "th")).select(
        id_col,
        "unit_no",
        F.regexp_extract(path, r"^(.*/table\[\d+\])", 1).alias("table_path"),
        F.regexp_extract(path, r"^(.*/tr\[\d+\])", 1).alias("row_path"),
        F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("text"),
    )
    first = F.min("unit_no").over(Window.partitionBy(id_col, "table_path", "row_path"))
    row = F.dense_rank().over(Window.partitionBy(id_col, "table_path").orderBy("first"))
    col = F.row_number().over(Window.partitionBy(id_col, "table_path", "row_path").orderBy("unit_no"))
    return cells.withColumn("first", first).select(id_col, "table_path", row.alias("row_no"), col.alias("col_no"), "text")


def word_offsets(words: DataFrame) -> DataFrame:
    """Adds char_start and char_end in the page's text: words by block, line and number, one character between two; empty words have no place."""
    order = Window.partitionBy("page_id").orderBy("block", "line", "word_no", "word")
    before = F.sum(F.length("word") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    broken = ~(F.lag(F.struct("block", "line")).over(order) == F.struct("block", "line"))
    placed = words.where("word <> ''").withColumns({"char_start": F.coalesce(before, F.lit(0)).cast("long"), "before": F.when(broken, "\n").when(broken.isNull(), "").otherwise(" ")})
    return placed.withColumn("char_end", F.col("char_start") + F.length("word"))


def page_texts(words: DataFrame) -> DataFrame:
    """page_id, text: the words of a line divided by blanks, the lines by line feeds."""
    parts = F.array_sort(F.collect_list(F.struct("char_start", F.concat("before", "word").alias("part"))))
    return word_offsets(words).groupBy("page_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("text"))


def span_rects(words: DataFrame, spans: DataFrame) -> DataFrame:
    """For each span (page_id, span_id, start, stop): one rectangle a line of the words it touches, and their union.

    A word carries on a line if its top is near the line's and it does not lie
    left of it; a span that touches no word gives no row.
    """
    box = F.struct("x0", "y0", "x1", "y1")
    hits = word_offsets(words).join(spans, "page_id").where("char_end > start AND char_start < stop")
    grouped = hits.groupBy("page_id", "span_id").agg(F.array_sort(F.collect_list(F.struct("char_start", box.alias("box")))).alias("hits"))
    wider = lambda a, b: F.struct(*[f(a[c], b[c]).alias(c) for f, c in ((F.least, "x0"), (F.least, "y0"), (F.greatest, "x1"), (F.greatest, "y1"))])

    def add(lines: Column, hit: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        carries = (F.abs(last["y0"] - hit["box"]["y0"]) < LINE_GAP) & (hit["box"]["x0"] >= last["x0"] - LINE_BACK)
        rest = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
        return F.when(carries, F.concat(rest, F.array(wider(last, hit["box"])))).otherwise(F.concat(lines, F.array(hit["box"])))

    lines = F.aggregate("hits", F.expr("CAST(array() AS array<struct<x0:double,y0:double,x1:double,y1:double>>)"), add)
    side = lambda c: F.transform("lines", lambda r: r[c])
    union = F.struct(*[f(side(c)).alias(c) for f, c in ((F.array_min, "x0"), (F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1"))])
    return grouped.withColumn("lines", lines).select("page_id", "span_id", "lines", union.alias("bounds"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))
def quote_spans(text: pd.Series, quote: pd.Series) -> pd.Series:
    """Ranges of the text that read as the quote but for case and white space, overlapping ones too; quotes under two characters have none. A letter whose other case is two letters (ß, SS) matches only itself."""

    def spans(whole: str | None, said: str | None) -> list[dict]:
        words = (said or "").split()
        if whole is None or len(" ".join(words)) < 2:
            return []
        pattern = re.compile("(?=(" + r"\s+".join(map(re.escape, words)) + "))", re.IGNORECASE)
        return [{"start": m.start(1), "stop": m.end(1)} for m in pattern.finditer(whole)]

    return pd.Series([spans(t, q) for t, q in zip(text, quote, strict=True)])


def amount_in(quote: Column, value: Column) -> Column:
    """Whether the quote names this amount, to two decimals and but for commas and sign."""
    named = F.regexp_extract_all(quote, F.lit(r"[\d,]+(?:\.\d+)?"), F.lit(0))
    same = lambda t: F.coalesce(F.bround(F.regexp_replace(t, ",", "").try_cast("decimal(30,6)"), 2) == F.bround(F.abs(value.cast("decimal(30,6)")), 2), F.lit(False))
    return F.exists(named, same)


def needs_reading(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < LEAST_TEXT


def declared_scale(text: Column, before: Column | None = None) -> Column:
    """The scale that the last declaration, like (Rs. in lakhs), names, in the singular; null without one. before: only text up to there."""
    window = text if before is None else F.substring(text, F.lit(1), before)
    named = F.regexp_extract_all(window, F.lit(r"(?i)\(\s*[`₹]?\s*(?:Rs\.?|INR|₹|`)?\s*in\s+([A-Za-z]{3,12})\s*\)"), F.lit(1))
    return F.regexp_replace(F.lower(F.try_element_at(named, F.lit(-1))), "s$", "")


def in_crores(rows: DataFrame, text_col: str = "text", amount_col: str = "amount") -> DataFrame:
    """Adds scale, status (declared, unknown_scale or undeclared) and crores: the amount converted and, if converted, at two decimals half even."""
    scaled = rows.withColumn("scale", declared_scale(F.col(text_col)))
    factor = F.create_map(*[F.lit(x).cast("decimal(10,4)") if i % 2 else F.lit(x) for pair in SCALES.items() for i, x in enumerate(pair)])
    known = F.try_element_at(factor, F.col("scale"))
    amount = F.col(amount_col).cast("decimal(24,6)")
    status = F.when(F.col("scale").isNull(), "undeclared").when(known.isNull(), "unknown_scale").otherwise("declared")
    converted = F.when(known == 1, amount).otherwise(F.bround(amount * known, 2))
    return scaled.withColumns({"status": status, "crores": F.when(known.isNotNull(), converted)})
