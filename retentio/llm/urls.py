"""URL rules: host-suffix / path-prefix expressions joined on hash prefixes.

A rule is (host, path, verdict).  It fits its host and all subdomains when the
url's path starts with the rule's path.  Each url is expanded into the
expressions the rule table can hold - one per distinct *shape* (number of host
labels, path length) among the rules - so the work per url depends on the
shapes, not on the number of rules or the length of the url.  Expressions meet
rules in an equi-join on a short hash prefix; the full digest confirms, and
the longest rule wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8  # 32-bit hash prefix


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/ ? #`` or the end, A-Z lowered; '' for null or no scheme."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """Text after the host up to ``? #`` or the end; '' for null or no scheme."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Distinct usable rules with their digest; NULL hosts or verdicts are no rules, a NULL path is ''."""
    host = F.translate(F.col("host"), string.ascii_uppercase, string.ascii_lowercase)
    return (
        rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull())
        .select(host.alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"),
                F.col("verdict").alias("r_verdict"))
        .withColumn("r_rule", F.concat("r_host", "r_path"))
        .withColumn("r_digest", _digest(F.col("r_rule")))
        .withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_HEX))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ("page_id",),
               url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: the ``keep`` columns, ``host``, ``path``, ``rule``, ``verdict``.

    * the longest fitting rule (host + path) wins; at equal length the longer
      host, then ``block``, then the verdict's name decide;
    * no fitting rule: ``rule`` is NULL and ``verdict`` is ``default``;
    * NULL url or no ``://``: host and path are '' (no rule with a host fits);
    * repeated rows stay repeated, an empty table gives an empty result, other
      columns of ``pages`` (also ones named like the added columns) are ignored.

    Only the list of rule shapes reaches the driver: at most (host labels x
    path lengths) pairs, whatever the number of rules.  Whether the rule side
    is broadcast is left to Catalyst's byte threshold; beyond it the join
    shuffles on the prefix and adaptive execution splits hot prefixes.
    """
    rules = prepare_rules(rules)
    shapes = sorted(
        (r[0], r[1]) for r in
        rules.select(_labels(F.col("r_host")), F.length("r_path")).distinct().collect())
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    base = pages.select(
        F.monotonically_increasing_id().alias("_rid"), *kept,
        url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    expressions = [
        F.when((_labels(F.col("host")) >= k) & (F.length("path") >= n),
               F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n)))
        for k, n in shapes
    ]
    found = F.array_compact(F.array(*expressions)) if expressions else F.lit(None).cast("array<string>")
    probes = (
        base.withColumn("_expr", F.explode_outer(found))
        .withColumn("_digest", _digest(F.col("_expr")))
        .withColumn("_prefix", F.substring("_digest", 1, PREFIX_HEX))
    )
    best = F.max(F.when(F.col("r_rule").isNotNull(), F.struct(
        F.length("r_rule").alias("n"), F.length("r_host").alias("h"),
        (F.col("r_verdict") == "block").alias("b"), F.col("r_verdict").alias("verdict"),
        F.col("r_rule").alias("rule"))))
    same = (F.col("_prefix") == F.col("r_prefix")) & (F.col("_digest") == F.col("r_digest"))
    carried = [*(f"_k{i}" for i in range(len(keep))), "host", "path"]
    return (
        probes.join(rules, same, "left")
        .groupBy("_rid").agg(*[F.first(c).alias(c) for c in carried], best.alias("_best"))
        .select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "host", "path",
                F.col("_best.rule").alias("rule"),
                F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
    )
