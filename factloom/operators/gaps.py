"""Corpus gaps: entries of a source's own history that no primary document of ours accounts for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators.timeline import LINE

MATCH_DAYS = 3


def matched_dates(history: DataFrame, primary: DataFrame, days: int = MATCH_DAYS) -> DataFrame:
    """The (line, date, grade) of history that a primary action records: each absorbs its nearest date only, ties to the earlier.

    The date band is an equi-join on blocks of `days` + 1 days, each primary
    action standing in its own and both neighbouring blocks.
    """
    block = lambda c: F.floor(F.unix_date(F.col(c)) / (days + 1))
    h = history.select(*LINE, F.col("action_date").alias("day"), "grade").distinct().withColumn("block", block("day"))
    p = primary.select(*LINE, "claim_id", "action_date", F.col("grade").alias("held"), "action")
    p = p.withColumn("block", F.explode(F.array(*[block("action_date") + k for k in (-1, 0, 1)])))
    fits = F.when(F.col("grade").isNull(), text.is_withdrawal(F.col("action"))).otherwise(F.col("grade").eqNullSafe(F.col("held")))
    distance = F.abs(F.datediff("day", "action_date"))
    near = p.join(h, [*LINE, "block"]).where((distance <= days) & fits)
    return near.groupBy(*LINE, "claim_id").agg(F.min_by(F.struct("day", "grade"), F.struct(distance, "day", "grade")).alias("m")).select(*LINE, "m.day", "m.grade").distinct()


def find_gaps(history: DataFrame, primary: DataFrame) -> DataFrame:
    """One row a gap with its claims as evidence, whether it lies within what our documents cover, and whether it changes the agency's view.

    Its view (outlook, watch) is its first claim's. The view before is all that the agency said on its latest earlier
    date, in primary documents or history; without one the gap is taken to matter.
    """
    matched = matched_dates(history, primary)
    since = primary.groupBy(*LINE).agg(F.min("action_date").alias("since"))
    same = [history[c] == matched[c] for c in LINE] + [history["action_date"] == matched["day"], history["grade"].eqNullSafe(matched["grade"])]
    left = history.join(matched, same, "left_anti").join(since, LINE, "left")
    scope = F.when(F.col("action_date") > F.col("since"), "within_corpus").otherwise("before_corpus")
    found = left.groupBy(*LINE, "action_date", F.coalesce("grade", F.lit("")).alias("grade")).agg(
        F.min(scope).alias("scope"),
        F.count("*").alias("n_evidence"),
        F.min("claim_id").alias("first_claim"),
        F.min_by(F.struct("outlook", "watch"), "claim_id").alias("view"),
        F.array_sort(F.collect_list("claim_id")).alias("evidence"),
    )
    views = ["grade", "outlook", "watch"]
    known = history.select(*LINE, "action_date", *views).unionByName(primary.select(*LINE, "action_date", *views)).distinct()
    line = Window.partitionBy(*LINE).orderBy("action_date")
    days = known.select(*LINE, "action_date").distinct().withColumn("before", F.lag("action_date").over(line))
    told = known.select(*LINE, F.col("action_date").alias("before"), F.struct(*views).alias("told"))
    own = F.struct(F.nullif("grade", F.lit("")).alias("grade"), F.col("view.outlook").alias("outlook"), F.col("view.watch").alias("watch"))
    asked = found.join(days, [*LINE, "action_date"], "left").withColumn("own", own)
    heard = asked.join(told, [*LINE, "before"], "left").groupBy(*LINE, "action_date", "grade").agg(F.bool_or(F.coalesce(F.col("told").eqNullSafe(F.col("own")), F.lit(False))).alias("__same"))
    return found.join(heard, [*LINE, "action_date", "grade"]).withColumn("changes_view", ~F.col("__same")).select("*", "view.*").drop("view", "__same")
