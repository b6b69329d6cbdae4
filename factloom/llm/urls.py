"""URL filtering by a rule list: a blocked Bloom filter passes possible hits to an exact hash join.

Everything here is DataFrame expressions. A rule (host, path, verdict) fits its
host and all subdomains where the URL's path starts with the rule's path, so a
URL is first looked up under its own host suffixes, in a table of the rules'
hosts with the path lengths that each has, and then under its path prefixes of
those lengths: as many keys as its path has characters at most, however many
rules there are. Both lookups pass a Bloom filter before they are joined. Distinct hosts and paths are judged once and joined back as join_hot does
it, so that a URL that fills a third of the table does not meet in one task.

Defined results: a URL that is null or has no `://` has an empty host and path
and gets the default verdict; rules with a null field are left out; of equal
rules that disagree, block wins; of several fitting rules the longest
(host and path together) wins, then the one with the longer host; repeated
rows are judged alike and all returned; columns of the names that are added
are replaced; an empty table or rule list gives no rows or no rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import join_hot

RULES = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())])
BITS_PER_KEY = 16
WORDS = 4  # of 64 bits a block, two bits of each word for a key
#: Filters of up to so many blocks (40 bytes each) are broadcast, larger ones shuffled.
BROADCAST_BLOCKS = 1 << 20
#: Rule lists of up to so many rows are broadcast to the exact join, longer ones shuffled.
BROADCAST_RULES = 1 << 17

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """For each word of a block the two bits that a key sets."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))
    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(WORDS)]


def _blocks(keys: int) -> int:
    return max(1, -(-keys * BITS_PER_KEY // (64 * WORDS)))


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table: block, w0 .. w3."""
    marked = keys.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col(key)))])
    return marked.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_hits(candidates: DataFrame, key: str, blooms: DataFrame, blocks: int) -> DataFrame:
    """The candidates whose bits are all set; false positives remain."""
    blooms = F.broadcast(blooms) if blocks <= BROADCAST_BLOCKS else blooms
    joined = candidates.withColumn("block", _block(F.col(key), blocks)).join(blooms, "block")
    is_set = [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col(key)))]
    return joined.where(reduce(Column.__and__, is_set)).select(*candidates.columns)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict. rules: host, path, verdict ('allow' or 'block')."""
    listed = (
        rules.dropna(subset=["host", "path", "verdict"])
        .select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("rule_verdict"))
        .withColumn("key", F.concat_ws("\n", "rule_host", "rule_path"))
    )
    hosts = listed.groupBy("rule_host").agg(F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths"))
    stats = listed.agg(F.count("*").alias("n"), F.count_distinct("rule_host").alias("hosts")).first()
    added = ["host", "path", "rule", "verdict"]
    source = pages.select(*[c for c in pages.columns if c not in added], *[e.alias(n) for e, n in zip(split_url(F.col(url_col)), added, strict=False)])
    if not stats.n:
        return source.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    few = stats.n <= BROADCAST_RULES
    names = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, F.size(names) - k + 1, k), "."))
    urls = source.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"))
    blocks = _blocks(stats.hosts)
    under = possible_hits(urls, "rule_host", bloom_filter(hosts, "rule_host", blocks), blocks)
    known = under.join(F.broadcast(hosts), "rule_host") if few else join_hot(under, hosts, ["rule_host"])
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    looked_up = known.select("host", "path", "rule_host", F.explode(fitting).alias("n")).select("host", "path", F.concat_ws("\n", "rule_host", F.expr("substring(path, 1, n)")).alias("key"))
    blocks = _blocks(stats.n)
    hits = possible_hits(looked_up, "key", bloom_filter(listed, "key", blocks), blocks)
    exact = F.broadcast(listed) if few else listed.hint("shuffle_hash")
    longest = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), "rule_host", "rule_path")
    found = (
        hits.join(exact, "key")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), longest).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    return join_hot(source, found, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
