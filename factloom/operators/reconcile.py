"""Comparing what sources say: numeric tolerances, categorical conflicts, corroboration, report diffs, durable state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text

# fixed values: a spread over 0.10 % or, for amounts in crore, a gap over 5 is a disagreement
TOLERANCE_PCT, TOLERANCE_ABS, ABSOLUTE_UNIT = 0.10, 5, "INR_CRORE"
# fixed values: keys that are never compared, by prefix; why not in our own words
EXCLUDED = [
    ("rated_amount|", "how much of a programme one agency was asked to rate is no shared quantity"),
    ("instrument|", "the amount is part of the key, so that agreement would prove nothing"),
    ("rating_history|", "an agency's record of its own actions, compared only as rating states"),
]
MIXED = "adjusted figures are compared only with adjusted ones"


def exclusion(key: Column) -> Column:
    """Why a key is not compared; null if it is."""
    found = F.lit(None).cast("string")
    for prefix, reason in reversed(EXCLUDED):
        found = F.when(key.startswith(prefix), reason).otherwise(found)
    return found


def over_share(low: Column, high: Column) -> Column:
    """Whether the spread is over the relative tolerance: of a lowest value above zero alone, exact in integers and decimals."""
    return F.when(low > 0, (high - low) * 1000 > low).otherwise(False)


def disagrees(low: Column, high: Column, unit: Column) -> Column:
    """Whether two values differ by more than either tolerance; the absolute one is for amounts in crore."""
    return over_share(low, high) | ((unit == ABSOLUTE_UNIT) & (high - low > TOLERANCE_ABS))


def explanation(low: Column, high: Column, unit: Column) -> Column:
    """The gap and its share, at three decimals half even, and which tolerance it is over."""
    gap, over_pct = high - low, over_share(low, high)
    over_abs = (unit == ABSOLUTE_UNIT) & (gap > TOLERANCE_ABS)
    wide = lambda c: c.cast("decimal(20,0)")
    share = F.concat(F.when(low == 0, F.lit("0.000")).otherwise(F.bround(wide(gap * 100) / F.nullif(wide(low), wide(F.lit(0))), 3).cast("decimal(20,3)").cast("string")), F.lit("%"))
    told = F.concat(F.lit("₹"), gap.cast("string"), F.lit(" crore ("), share, F.lit(")"))
    return (
        F.when(over_pct & over_abs, F.concat(told, F.lit(" — over both the 0.10% and ₹5 crore tolerances")))
        .when(over_pct, F.concat(told, F.lit(" — above the 0.10% tolerance")))
        .when(over_abs, F.concat(F.lit("₹"), gap.cast("string"), F.lit(" crore — above the ₹5 crore tolerance, though only "), share, F.lit(" of the reported figure")))
        .otherwise(F.concat(told, F.lit(" — within both tolerances")))
    )


def comparable(claims: DataFrame) -> DataFrame:
    return claims.where(exclusion(F.col("fact_key")).isNull())


def _facts(claims: DataFrame, said: Column) -> DataFrame:
    """One row a fact that more than one document and source state, of the claims that state it."""
    return (
        claims.where(said.isNotNull())
        .groupBy("issuer_id", "fact_key")
        .agg(
            F.count_distinct("document_id").alias("n_documents"),
            F.count_distinct("source_name").alias("n_sources"),
            (F.bool_or(F.col("basis") == "agency_adjusted") & F.bool_or(F.col("basis") != "agency_adjusted")).alias("mixed"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.min_by("unit", "claim_id").alias("unit"),
            F.count_distinct(text.normalise(F.col("value_text"))).alias("n_texts"),
        )
        .where("n_documents > 1 AND n_sources > 1")
    )


def numeric_facts(claims: DataFrame) -> DataFrame:
    """Facts stated by several sources with their range; mixed bases are named, not compared."""
    status = F.when(F.col("mixed"), "mixed_basis").when(disagrees(F.col("low"), F.col("high"), F.col("unit")), "conflict").otherwise("corroborated")
    why = F.when(~F.col("mixed"), explanation(F.col("low"), F.col("high"), F.col("unit")))
    return _facts(comparable(claims), F.col("value")).select("issuer_id", "fact_key", "n_documents", "n_sources", "low", "high", "unit", status.alias("status"), why.alias("why"))


def categorical_conflicts(claims: DataFrame) -> DataFrame:
    """Facts whose texts differ after normalising, with what each source says."""
    words = text.normalise(F.col("value_text"))
    said = comparable(claims).where(words.isNotNull()).select("issuer_id", "fact_key", "source_name", "value_text").distinct()
    by_source = said.groupBy("issuer_id", "fact_key", "source_name").agg(F.array_join(F.array_sort(F.collect_set("value_text")), " / ").alias("says"))
    lines = by_source.groupBy("issuer_id", "fact_key").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" says ", "source_name", "says"))), "; ").alias("summary"))
    facts = _facts(comparable(claims), words).where("n_texts > 1 AND NOT mixed")
    return facts.join(lines, ["issuer_id", "fact_key"]).select("issuer_id", "fact_key", "n_texts", "summary")


def excluded_keys(claims: DataFrame) -> DataFrame:
    """Facts of several sources that are not compared, and why not."""
    facts = _facts(claims, F.coalesce(F.col("value").cast("string"), text.normalise(F.col("value_text"))))
    reason = F.coalesce(exclusion(F.col("fact_key")), F.when(F.col("mixed"), MIXED))
    return facts.withColumn("reason", reason).where("reason IS NOT NULL").select("issuer_id", "fact_key", "reason")


def report_diff(reports: DataFrame) -> DataFrame:
    """What each source's report added, removed or changed against its previous one; a key's last claim counts."""
    latest = reports.groupBy("agency_id", "report", "item").agg(F.max_by("value_text", "claim_id").alias("value"))
    order = latest.select("agency_id", "report").distinct()
    line = Window.partitionBy("agency_id").orderBy("report")
    pairs = order.withColumn("to_report", F.lead("report").over(line)).where("to_report IS NOT NULL").withColumnRenamed("report", "from_report")
    old = latest.withColumnsRenamed({"report": "from_report", "value": "before"}).join(pairs, ["agency_id", "from_report"])
    new = latest.withColumnsRenamed({"report": "to_report", "value": "after"}).join(pairs, ["agency_id", "to_report"])
    both = old.join(new, ["agency_id", "from_report", "to_report", "item"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return both.withColumn("direction", kind)


def certain(diff: DataFrame, reports: DataFrame) -> DataFrame:
    """diff with its certainty: what a report lacks is unconfirmed unless that report was read completely. reports: agency_id, report, complete."""
    read = lambda of: reports.select("agency_id", F.col("report").alias(of), F.col("complete").alias(f"__{of}"))
    told = diff.join(read("from_report"), ["agency_id", "from_report"], "left").join(read("to_report"), ["agency_id", "to_report"], "left")
    lacking = F.when(F.col("direction") == "added", F.col("__from_report")).when(F.col("direction") == "removed", F.col("__to_report")).otherwise(True)
    return told.withColumn("certainty", F.when(F.coalesce(lacking, F.lit(False)), "confirmed").otherwise("unconfirmed")).drop("__from_report", "__to_report")


def merge_state(state: DataFrame, found: DataFrame, key: list[str], run: str) -> DataFrame:
    """Durable lifecycle rows: found ones are opened, seen again or reopened; missing ones are resolved, never deleted.

    state: key, first_seen, last_seen, resolved_at (strings); found: key.
    """
    seen = found.select(*key).distinct().withColumn("__seen", F.lit(True))
    both = state.join(seen, key, "full_outer")
    hit = F.col("__seen").isNotNull()
    return both.select(
        *key,
        F.coalesce("first_seen", F.lit(run)).alias("first_seen"),
        F.when(hit, F.lit(run)).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(hit, None).otherwise(F.coalesce("resolved_at", F.lit(run))).alias("resolved_at"),
    )
