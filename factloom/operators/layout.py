"""Geometry of printed pages: visual lines of word boxes, phrases, and tables of boxes.

A word is a row (document_id, page_no, word_no, text, x0, y0, x1, y1): word_no
orders the words as the page's text does. Everything is windows over a page and
expressions over the words of one line; a page never meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["document_id", "page_no"]


def visual_lines(words: DataFrame, tolerance: float, within: tuple[str, ...] = ()) -> DataFrame:
    """words with line_no (from 1 in each page, down the page) and line_y, the line's height.

    Words are taken by their middle height, then from the left; one opens a new line if its middle lies more than
    `tolerance` under that of the line's first word. Lines of words that chain over a longer way are cut by that rule
    too, so a line does not grow with its words. within: further columns that divide a page, in their order.
    """
    words = words.withColumn("yc", (F.col("y0") + F.col("y1")) / 2)
    page = [*PAGE, *within]
    down = Window.partitionBy(*page).orderBy("yc", "x0", "word_no")
    apart = F.coalesce((F.col("yc") - F.lag("yc").over(down) > tolerance).cast("int"), F.lit(0))
    chained = words.withColumn("__chain", apart).withColumn("__chain", F.sum("__chain").over(down))
    heights = F.array_sort(F.collect_set("yc").over(Window.partitionBy(*page, "__chain")))

    def open_line(starts: Column, y: Column) -> Column:
        return F.when((F.size(starts) == 0) | (y - F.coalesce(F.try_element_at(starts, F.lit(-1)), y) > tolerance), F.concat(starts, F.array(y))).otherwise(starts)

    starts = F.aggregate(heights, F.array().cast("array<double>"), open_line)
    lined = chained.withColumn("__starts", starts).withColumn("line_y", F.array_max(F.filter("__starts", lambda s: s <= F.col("yc"))))
    number = F.dense_rank().over(Window.partitionBy(*PAGE).orderBy(*within, "line_y"))
    return lined.withColumn("line_no", number).drop("__chain", "__starts")


def lines_of(words: DataFrame) -> DataFrame:
    """One row a line of words that have line_no: line_y, its words from the left, and its text. A column row_at, where there is one, orders words before that."""
    first = F.col("row_at") if "row_at" in words.columns else F.lit(0)
    box = F.struct(first.cast("double").alias("row_at"), *[F.col(c).cast("bigint" if c == "word_no" else "string" if c == "text" else "double").alias(c) for c in ("x0", "yc", "word_no", "text", "x1", "y0", "y1")])
    lines = words.groupBy(*PAGE, "line_no").agg(F.min("line_y").alias("line_y"), F.array_sort(F.collect_list(box)).alias("words"))
    return lines.withColumn("text", joined("words"))


def page_lines(words: DataFrame, tolerance: float) -> DataFrame:
    """lines_of(visual_lines(words, tolerance)): words are gathered where their heights chain, and lines cut and numbered after that, so that no word is sorted again; a word keeps its text, its number and how far it reaches."""
    words = words.withColumn("yc", (F.col("y0") + F.col("y1")) / 2)
    down = Window.partitionBy(*PAGE).orderBy("yc", "x0", "word_no")
    apart = F.coalesce((F.col("yc") - F.lag("yc").over(down) > tolerance).cast("int"), F.lit(0))
    chained = words.withColumn("__chain", apart).withColumn("__chain", F.sum("__chain").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    box = F.struct(*[F.col(c).cast("bigint" if c == "word_no" else "string" if c == "text" else "double").alias(c) for c in ("x0", "yc", "word_no", "text", "x1")])
    chains = chained.groupBy(*PAGE, "__chain").agg(F.min("yc").alias("__first"), F.max("yc").alias("__last"), F.array_sort(F.collect_list(box)).alias("__words"))

    def open_line(starts: Column, y: Column) -> Column:
        return F.when((F.size(starts) == 0) | (y - F.coalesce(F.try_element_at(starts, F.lit(-1)), y) > tolerance), F.concat(starts, F.array(y))).otherwise(starts)

    one = F.col("__last") - F.col("__first") <= tolerance
    heights = F.array_sort(F.array_distinct(F.transform("__words", lambda w: w["yc"])))
    starts = F.when(one, F.array("__first")).otherwise(F.aggregate(heights, F.array().cast("array<double>"), open_line))
    inside = lambda s, i: F.filter("__words", lambda w: (w["yc"] >= s) & ((i + 1 == F.size("__starts")) | (w["yc"] < F.get("__starts", i + 1))))
    cut = F.when(one, F.array(F.struct(F.col("__first").alias("line_y"), F.col("__words").alias("words")))).otherwise(F.transform("__starts", lambda s, i: F.struct(s.alias("line_y"), inside(s, i).alias("words"))))
    lines = chains.withColumn("__starts", starts).select(*PAGE, F.explode(cut).alias("l")).select(*PAGE, "l.line_y", "l.words")
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_y"))).select(*PAGE, "line_no", "line_y", "words", joined("words").alias("text"))


def joined(words: Column | str) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def phrases(words: Column, gap: float) -> Column:
    """The phrases of a line (text, x0, x1): words with at most `gap` between them."""
    kind = "array<struct<text:string,x0:double,x1:double>>"

    def add(made: Column, w: Column) -> Column:
        last = F.try_element_at(made, F.lit(-1))
        longer = F.struct(F.concat_ws(" ", last["text"], w["text"]).alias("text"), last["x0"].alias("x0"), w["x1"].alias("x1"))
        alone = F.struct(w["text"].alias("text"), w["x0"].alias("x0"), w["x1"].alias("x1"))
        return F.when(w["x0"] - last["x1"] <= gap, F.concat(F.slice(made, 1, F.size(made) - 1), F.array(longer))).otherwise(F.concat(made, F.array(alone)))

    return F.aggregate(words, F.array().cast(kind), add)


def stacked(parts: Column) -> Column:
    """Phrases of lines above each other as columns (x0, x1, text): one joins the first column that it overlaps, else opens one."""
    kind = "array<struct<x0:double,x1:double,text:string>>"

    def add(made: Column, p: Column) -> Column:
        meets = lambda s: (p["x0"] < s["x1"]) & (p["x1"] > s["x0"])
        wider = lambda at: lambda s, k: F.when(k + 1 == at, F.struct(F.least(s["x0"], p["x0"]).alias("x0"), F.greatest(s["x1"], p["x1"]).alias("x1"), F.concat_ws(" ", s["text"], p["text"]).alias("text"))).otherwise(s)
        new = F.array(F.struct(p["x0"].alias("x0"), p["x1"].alias("x1"), p["text"].alias("text")))
        joins = lambda at: F.when(at > 0, F.transform(made, wider(at))).otherwise(F.concat(made, new))
        # the place is worked out once, not for each phrase that is made
        return F.get(F.transform(F.array(F.array_position(F.transform(made, meets), F.lit(True))), joins), F.lit(0))

    return F.array_sort(F.aggregate(parts, F.array().cast(kind), add))


def named_runs(words: Column, names: dict[str, str], longest: int) -> Column:
    """Runs of up to `longest` words that have a name (kind, x0, x1), the longest first, from the left, none over another."""
    known = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    kind = "struct<next:int,found:array<struct<kind:string,x0:double,x1:double>>>"

    def hit_at(i: Column) -> Column:
        hits = [F.struct(F.try_element_at(known, F.lower(F.regexp_replace(joined(F.slice(words, i + 1, k)), ":+$", ""))).alias("kind"), F.lit(k).alias("k"), i.alias("i")) for k in range(longest, 0, -1)]
        return F.try_element_at(F.filter(F.array(*hits), lambda h: h["kind"].isNotNull() & (i + h["k"] <= F.size(words))), F.lit(1))

    def step(state: Column, hit: Column) -> Column:
        run = F.struct(hit["kind"].alias("kind"), F.get(words, hit["i"])["x0"].alias("x0"), F.get(words, hit["i"] + hit["k"] - 1)["x1"].alias("x1"))
        taken = F.struct((hit["i"] + hit["k"]).alias("next"), F.concat(state["found"], F.array(run)).alias("found"))
        return F.when(hit["i"] < state["next"], state).otherwise(taken.cast(kind))

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<kind:string,x0:double,x1:double>>").alias("found")).cast(kind)
    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    # each place is looked up once: what the steps name several times is worked out before them
    return F.aggregate(F.array_compact(F.transform(places, hit_at)), start, step)["found"]


def spans_read(text: Column, spans: Column, evidence: Column) -> Column:
    """Whether spans (start, stop) lie in the text, none empty, and read as the evidence, joined by blanks."""
    inside = F.forall(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["stop"]) & (s["stop"] <= F.length(text)))
    said = F.array_join(F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["stop"] - s["start"])), " ")
    return F.coalesce((F.size(spans) > 0) & inside & (said == evidence), F.lit(False))
