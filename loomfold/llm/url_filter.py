"""URL rules by host-suffix and path-prefix expressions.

Each URL expands into the suffixes of its host and the prefixes of its path that a rule could have by
its number of labels and its length.
Expressions meet rules in an equi-join on the first bytes of their digest; the full digest then
confirms a rule, and the longest confirmed rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, lower_az, pinned

RULE_SCHEMA = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return lower_az(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(n) for n in values]).cast("array<int>")


def host_suffixes(host: Column, label_counts: list[int]) -> Column:
    """The host and the domains that it is under, of those numbers of labels that rules have; none for an empty host."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    fitting = F.filter(numbers(label_counts), lambda n: (n <= labels) & (host != ""))
    # What stands after the n-th dot from the right, all without one.
    return F.transform(fitting, lambda n: F.call_function("substring_index", host, F.lit("."), -n))


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """The starts of the path of those lengths that paths of rules have."""
    return F.transform(F.filter(numbers(lengths), lambda n: n <= F.length(path)), lambda n: F.call_function("substring", path, F.lit(1), n))


def prepared_rules(rules: DataFrame, hash_bytes: int) -> DataFrame:
    """One row a rule with its digest; of rules for the same host and path, block wins."""
    one = rules.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("path").isNotNull()).groupBy(lower_az(F.col("host")).alias("host"), "path").agg(F.min_by("verdict", F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("verdict"))
    full = F.sha2(F.concat("host", F.lit("\n"), "path"), 256)
    return one.select(F.concat("host", "path").alias("rule"), "verdict", full.alias("rule_digest"), F.substring(full, 1, 2 * hash_bytes).alias("short"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", hash_bytes: int = 4, broadcast_rules: int = 1_000_000) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict.

    A rule fits its host and all its subdomains if the path starts with the rule's; the longest rule
    wins, and where none fits ``rule`` is null and the verdict is ``default``. A null url, or one
    without ://, has empty host and path and fits no rule. Rules are broadcast when they number at most ``broadcast_rules``;
    beyond that both sides are shuffled on the short hash. An address has as many expressions as rules have
    distinct numbers of labels times distinct lengths of paths, at most, however long it is.
    """
    urls = pages.select(pages[id_col].alias("id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    # Lengths and numbers of labels, not rules: at most as many as the longest rule has characters.
    shapes = rules.where("host <> '' AND path IS NOT NULL").select(F.length("path"), F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).distinct().collect()
    lengths, label_counts = (sorted({r[k] for r in shapes}) for k in (0, 1))
    known = bounded(pinned(prepared_rules(rules, hash_bytes)), broadcast_rules)
    # Expanded where they are read, by as many tasks; the join with the rules leaves few of the expressions, and these are shuffled.
    hosts = urls.select("host", "path").where("host != ''").withColumn("suffix", F.explode(host_suffixes(F.col("host"), label_counts)))
    spelled = hosts.withColumn("prefix", F.explode(path_prefixes(F.col("path"), lengths)))
    digested = spelled.withColumn("digest", F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256)).withColumn("short", F.substring("digest", 1, 2 * hash_bytes))
    met = digested.join(known, "short").where(F.col("digest") == F.col("rule_digest"))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("verdict"))).alias("best")).withColumnRenamed("host", "at")
    # An empty host fits no rule; such rows are spread by their id rather than meet in one key.
    spread = urls.withColumn("at", F.when(F.col("host") == "", F.concat(F.lit("\u0000"), F.xxhash64("id").cast("string"))).otherwise(F.col("host")))
    judged = spread.join(pinned(best), ["at", "path"], "left")
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
