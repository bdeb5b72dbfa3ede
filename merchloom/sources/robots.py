"""robots.txt as rows, and the permission test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.url import origin_of, path_and_query


def parse_robots(files: DataFrame, user_agent: str) -> DataFrame:
    """Rows (origin, text) to (origin, kind, pattern) of the groups that apply to an agent.

    Consecutive user-agent lines share a group; groups that name the agent beat those for all. One file is small, so
    windows run within an origin.
    """
    lines = files.select("origin", F.posexplode(F.split("text", "\r?\n")).alias("pos", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", "#.*$", "")))
    lines = lines.where(F.col("line").contains(":")).select("origin", "pos", F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value"))
    lines = lines.where(F.col("key").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("origin").orderBy("pos")
    is_agent = F.col("key") == "user-agent"
    lines = lines.withColumn("starts", (is_agent & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")).cast("int"))
    lines = lines.withColumn("grp", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    token = user_agent.lower()
    agent = F.lower("value")
    named = is_agent & (agent != "*") & F.lit(token).contains(agent)
    every = (is_agent & (agent == "*")) | (F.col("grp") == 0)  # rules before any agent are for all
    groups = lines.groupBy("origin", "grp").agg(F.bool_or(named).alias("named"), F.bool_or(every).alias("every"))
    by_origin = groups.groupBy("origin").agg(F.bool_or("named").alias("any_named"))
    chosen = groups.join(by_origin, "origin").where("(any_named AND named) OR (NOT any_named AND every)").select("origin", "grp")
    return lines.where(~is_agent & ~((F.col("key") == "disallow") & (F.col("value") == ""))).join(chosen, ["origin", "grp"]).select("origin", F.col("key").alias("kind"), F.col("value").alias("pattern"))


def pattern_matches(pattern: Column, target: Column) -> Column:
    """'*' stands for anything, a final '$' for the end, the rest for itself; an empty pattern never matches."""
    body = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    regex = F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), "$").otherwise(""))
    return (pattern != "") & F.regexp_like(target, regex)


def permitted(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Adds allowed: the longest matching Allow is as long as the longest matching Disallow, or none forbids."""
    mine = F.array_compact(F.transform("rules", lambda r: F.when(pattern_matches(r["pattern"], F.col("target")), r)))
    longest = lambda k: F.array_max(F.transform(F.filter("hits", lambda r: r["kind"] == k), lambda r: F.length(r["pattern"])))
    by_origin = rules.groupBy("origin").agg(F.collect_list(F.struct("kind", "pattern")).alias("rules"))
    out = urls.withColumn("origin", origin_of(F.col(url))).withColumn("target", path_and_query(F.col(url))).join(by_origin, "origin", "left")
    out = out.withColumn("hits", F.coalesce(mine, F.array().cast("array<struct<kind:string,pattern:string>>")))
    allowed = F.when(longest("disallow").isNull(), True).when(longest("allow").isNull(), False).otherwise(longest("allow") >= longest("disallow"))
    return out.withColumn("allowed", allowed).drop("origin", "target", "rules", "hits")
