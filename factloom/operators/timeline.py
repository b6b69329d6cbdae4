"""Effective dating: states of each source, overlaps of different sources, and runs of disagreement.

Scale: every operator partitions by (issuer, class, term); sources of one such
key meet in a join on equal keys and years with a range condition, never in a
cross join, so a scope that is rated for decades is dealt out by years.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text

FOREVER = "9999-12-31"
LINE = ["issuer_id", "agency", "instrument_class", "term"]
SHARED = ["issuer_id", "instrument_class", "term"]
#: What two concurrent ratings can disagree about.
ASPECTS = ("grade", "outlook", "watch")


def states(actions: DataFrame) -> DataFrame:
    """Each action with the interval in which it was in force.

    It ends on the line's next distinct date; a withdrawal ends on its own. The
    end rests on a primary action if there is one that day, else on the first
    history claim, which is then named.
    """
    dates = actions.groupBy(*LINE, "action_date").agg(
        F.bool_or(F.col("provenance") == "primary_rationale").alias("primary"),
        F.min(F.when(F.col("provenance") == "history_annexure", F.col("claim_id"))).alias("history_claim"),
    )
    line = Window.partitionBy(*LINE).orderBy("action_date")
    after = dates.select(*LINE, "action_date", *[F.lead(c).over(line).alias(f"next_{c}") for c in ("action_date", "primary", "history_claim")])
    gone = text.is_withdrawal(F.col("action"))
    basis = F.when(gone, "withdrawn").when(F.col("next_action_date").isNull(), None).when(F.col("next_primary"), "primary").otherwise("history")
    return actions.join(after, [*LINE, "action_date"]).select(
        "claim_id",
        *LINE,
        *ASPECTS,
        "instrument",
        F.col("action_date").alias("effective_from"),
        F.when(gone, F.col("action_date")).otherwise(F.col("next_action_date")).alias("effective_to"),
        gone.alias("withdrawn"),
        basis.alias("end_basis"),
        F.when(basis == "history", F.col("next_history_claim")).alias("superseded_by"),
        "provenance",
    )


def in_force(states: DataFrame, day: str) -> DataFrame:
    on = F.to_date(F.lit(day))
    return states.where((F.col("effective_from") <= on) & (F.coalesce("effective_to", F.to_date(F.lit(FOREVER))) > on))


def concurrent(states: DataFrame) -> DataFrame:
    """Pairs of different agencies whose states on the same scale overlap (half-open), with the overlap."""
    end = F.coalesce("effective_to", F.to_date(F.lit(FOREVER)))
    held = states.where(~F.col("withdrawn")).withColumn("until", end).where("effective_from < until")
    # a pair begins when its later state does, so states are met in the years up to the last beginning of their scope, and a pair in the year it begins
    last = held.groupBy(*SHARED).agg(F.max("effective_from").alias("last"))
    years = F.explode(F.sequence(F.year("effective_from"), F.year(F.least("until", "last"))))
    met = held.join(last, SHARED).withColumn("year", years)
    side = lambda tag: met.select(*SHARED, "year", *[F.col(c).alias(f"{tag}_{c}") for c in ("claim_id", "agency", *ASPECTS, "instrument", "effective_from", "until")])
    overlap = (F.col("a_effective_from") < F.col("b_until")) & (F.col("b_effective_from") < F.col("a_until")) & (F.col("a_agency") < F.col("b_agency"))
    begins = F.year(F.greatest("a_effective_from", "b_effective_from"))
    pairs = side("a").join(side("b"), [*SHARED, "year"]).where(overlap & (F.col("year") == begins)).drop("year")
    until = F.least("a_until", "b_until")
    return pairs.withColumns({"start": F.greatest("a_effective_from", "b_effective_from"), "end": F.when(until < F.to_date(F.lit(FOREVER)), until)})


def runs(windows: DataFrame, key: list[str], members: list[str], first: str | None = None) -> DataFrame:
    """Contiguous or overlapping windows (start, end; null: open) of one key become one run with all members.

    first: a column that the run takes from its first window; of windows that begin together, from the one whose value is smallest.
    """
    until = F.coalesce("end", F.to_date(F.lit(FOREVER)))
    ordered = Window.partitionBy(*key).orderBy("start", *members)
    reach = F.max(until).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = windows.withColumn("opens", F.when(F.coalesce(F.col("start") <= reach, F.lit(False)), 0).otherwise(1))
    numbered = opened.withColumn("run", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*key, "run").agg(
        F.min("start").alias("start"),
        F.max(until).alias("until"),
        F.count("*").alias("n_windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(*members))))).alias("members"),
        *([F.min_by(first, F.struct("start", first)).alias(first)] if first else []),
    )
    return merged.withColumn("end", F.when(F.col("until") < F.to_date(F.lit(FOREVER)), F.col("until"))).drop("until", "run")


def rating_conflicts(actions: DataFrame) -> DataFrame:
    """Runs in which two agencies held different grades, outlooks or watches; values are compared normalised, null is no opinion."""
    pairs = concurrent(states(actions))
    sides = [F.struct(F.lit(a).alias("aspect"), text.normalise(F.col(f"a_{a}")).alias("a_value"), text.normalise(F.col(f"b_{a}")).alias("b_value")) for a in ASPECTS]
    both = pairs.withColumn("side", F.explode(F.array(*sides))).select("*", "side.*").where("a_value <> b_value")
    return runs(both, [*SHARED, "aspect", "a_agency", "b_agency", "a_value", "b_value"], ["a_claim_id", "b_claim_id"])
