"""URL rules by a sort-merge range join (DataFrame functions only).

A rule is (verdict, host, path); it fits a url whose host is the rule's host or
a subdomain of it and whose path starts with the rule's path. The longest
fitting rule (characters of host and path) wins.

Method. A host turns into its reversed, dot-terminated form
(``www.example.com`` -> ``com.example.www.``), so "this host or a subdomain"
becomes the half-open interval ``[key, key with the last dot raised to '/')``.
Intervals of one rule path are nested or disjoint. A sweep over urls and
interval ends in (rule path, key) order keeps the stack of open rules: every
opening puts its rule on top, every closing uncovers the rule below, which is
known from the nesting; the active rule at a url is the state after the last
end before it. The sweep runs in range partitions of distinct (path, host key)
pairs, each started with the state the partitions before it end with, so no
host and no top-level domain meets in one task. The pairs are written once with
their partition's number: a plan that is run twice samples other range bounds.

Cases: a null url, or one without ``://``, has empty host and path, fits no
rule and gets the default verdict; so do empty tables (no rows) and hosts
outside all rules. Repeated rows each keep their own result. Extra columns are
kept as they are; columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import written

Rule = tuple[str, str, str]

RULES: list[Rule] = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]

#: rules travel inside the plan; a longer list belongs in several calls
MAX_RULES = 10_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/ ? #``, A-Z lower-cased;
    then up to ``? #``. Both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``www.example.com`` -> ``com.example.www.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _rule_ends(spark, rules: list[Rule]) -> DataFrame:
    """Interval ends: (rpath, key, active): the rule on top of the stack from
    ``key`` on, null where the stack is empty."""
    table = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("rhost"), F.lit(p).alias("rpath"))
        for v, h, p in rules])))
    key = host_key(F.col("rhost"))
    table = table.select("rpath", key.alias("lo"),
                         F.concat(F.expr("substring(lo, 1, length(lo) - 1)"), F.lit("/")).alias("hi"),
                         F.struct(F.length(F.concat("rhost", "rpath")).alias("size"),
                                  F.concat("rhost", "rpath").alias("rule"), "verdict").alias("top"))
    other = table.select("rpath", F.col("lo").alias("olo"), F.col("hi").alias("ohi"), F.col("top").alias("otop"))
    # the rule a closing uncovers: the innermost interval that strictly holds it
    below = (table.join(other, "rpath", "left")
             .groupBy("rpath", "lo", "hi", "top")
             .agg(F.max(F.when((F.col("olo") < F.col("lo")) & (F.col("ohi") >= F.col("hi")), F.col("otop")))
                  .alias("below")))
    return below.select("rpath", F.inline(F.array(
        F.struct(F.col("lo").alias("key"), F.lit(1).alias("kind"), F.col("top").alias("active")),
        F.struct(F.col("hi").alias("key"), F.lit(0).alias("kind"), F.col("below").alias("active")))))


def url_verdicts(pages: DataFrame, rules: list[Rule] = RULES, default: str = "allow",
                 url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null: none fits) and verdict."""
    if len(rules) > MAX_RULES or len({(h, p) for _, h, p in rules}) != len(rules):
        raise ValueError("rules: at most MAX_RULES, one for each host and path")
    spark = pages.sparkSession
    host, path = url_parts(F.col(url))
    rule_paths = sorted({p for _, _, p in rules})
    old = [c for c in pages.columns if c in ("host", "path", "rule", "verdict")]
    # the rule paths that the url's path starts with: a chain of prefixes
    fits = F.filter(F.array(*[F.lit(p) for p in rule_paths]).cast("array<string>"),
                    lambda p: F.startswith(F.col("path"), p))
    urls = (pages.drop(*old).withColumns({"host": host, "path": path})
            .withColumns({"__key": host_key(F.col("host")), "__paths": fits}))

    # one row for each distinct host and set of rule paths: a hot host is summed up before any shuffle
    keys = urls.where(F.size("__paths") > 0).select("__key", "__paths").distinct()
    points = keys.select(F.explode("__paths").alias("rpath"), F.col("__key").alias("key"), F.lit(2).alias("kind"),
                         F.lit(None).cast("struct<size:int,rule:string,verdict:string>").alias("active"),
                         F.col("__paths").alias("paths"))
    ends = _rule_ends(spark, rules).withColumn("paths", F.lit(None).cast("array<string>"))
    order = ["rpath", "key", "kind"]
    swept = written(points.unionByName(ends.select(*points.columns))
                    .withColumn("active", F.when(F.col("kind") < 2, F.struct("rpath", F.col("active").alias("a"))))
                    .repartitionByRange(*order)
                    .withColumn("part", F.spark_partition_id()), "url-rules")
    # the state each range partition starts with: the last end of the partitions before it (one row a partition)
    last = swept.groupBy("part").agg(F.max_by(
        F.when(F.col("kind") < 2, F.col("active")),
        F.when(F.col("kind") < 2, F.struct(*order))).alias("at_end"))
    carry = last.select("part", F.last("at_end", ignorenulls=True).over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    here = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    state = F.coalesce(F.last("active", ignorenulls=True).over(here), F.col("carried"))
    found = (swept.join(F.broadcast(carry), "part", "left")
             .withColumn("state", state)
             .where(F.col("kind") == 2)
             .select(F.col("key").alias("__key"), F.col("paths").alias("__paths"),
                     F.when(F.col("state.rpath") == F.col("rpath"), F.col("state.a")).alias("top"))
             .groupBy("__key", "__paths").agg(F.max("top").alias("__top")))
    return (urls.join(found, ["__key", "__paths"], "left")
            .withColumns({"rule": F.col("__top.rule"),
                          "verdict": F.coalesce(F.col("__top.verdict"), F.lit(default))})
            .drop("__key", "__paths", "__top"))
