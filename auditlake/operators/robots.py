"""robots.txt: groups and rules of a body, and the decision for a URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.functions import urls


def parse(bodies: DataFrame) -> DataFrame:
    """site, group_id, agents, rules (array of pos, directive, pattern) of each group of the bodies (site, body).

    User-agent lines in a row share the rules after them; the next one after a rule opens a group. Rules
    before any agent do not count, nor does an empty Disallow, though it ends the agents' list. Windows run
    within one body.
    """
    lines = bodies.select("site", F.posexplode(F.split("body", r"\R")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", r"\s*#.*$", ""))).filter(F.contains("line", F.lit(":")))
    field = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1))))
    lines = lines.withColumn("field", field).withColumn("value", F.trim(F.regexp_replace("line", r"^[^:]*:", ""))).filter(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("site").orderBy("pos")
    agent, rule = F.col("field") == "user-agent", F.col("field") != "user-agent"
    lines = lines.filter(rule | (F.col("value") != "") | agent)
    # an empty User-agent line only ends a group that has rules, as any other agent line does
    opens = agent & F.coalesce(F.lag(rule).over(order), F.lit(True))
    lines = lines.withColumn("group_id", F.sum(opens.cast("long")).over(order)).filter(agent | (F.col("group_id") > 0))
    groups = lines.groupBy("site", "group_id").agg(
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(agent & (F.col("value") != ""), F.struct("pos", F.lower("value").alias("v"))))), lambda x: x["v"])).alias("agents"),
        F.sort_array(F.collect_list(F.when(rule & ~((F.col("field") == "disallow") & (F.col("value") == "")), F.struct("pos", F.col("field").alias("directive"), F.col("value").alias("pattern"))))).alias("rules"),
    )
    return groups.filter(F.size("agents") > 0)


def pattern_regex(pattern: Column) -> Column:
    """Prefix match; * stands for anything, a $ at the end for the end."""
    ends = F.endswith(pattern, F.lit("$"))
    body = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*+", ".*"), F.when(ends, F.lit("$")).otherwise(F.lit("")))


def rules_for(groups: DataFrame, agent: str) -> DataFrame:
    """site, rules: those of the groups that name the agent (by a prefix of it), or else of * groups.

    What counts is whether the named groups have rules: a group with an empty Disallow alone falls back to *.
    One row per site, which is small; joins with pages broadcast it where its size allows.
    """
    agent = agent.lower()
    specific = F.exists("agents", lambda a: (a != "*") & (a != "") & F.startswith(F.lit(agent), a))
    wildcard = F.array_contains("agents", "*")
    g = groups.withColumn("kind", F.when(specific, 2).when(wildcard, 1)).filter("kind is not null and size(rules) > 0")
    g = g.groupBy("site").agg(*[F.sort_array(F.flatten(F.collect_list(F.when(F.col("kind") == k, F.col("rules"))))).alias(n) for k, n in ((2, "own"), (1, "any"))])
    g = g.select("site", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("any")).alias("rules"))
    return g.withColumn(
        "rules",
        F.transform("rules", lambda r: F.struct(r["directive"].alias("directive"), r["pattern"].alias("pattern"), pattern_regex(r["pattern"]).alias("regex"), F.char_length(F.replace(r["pattern"], F.lit("$"))).alias("specificity"), r["pos"].alias("pos"))),
    )


def decide(pages: DataFrame, rules: DataFrame, site: str = "site", url: str = "url") -> DataFrame:
    """Adds robots_allowed, matched_directive, matched_rule. The longest pattern wins, Allow on a tie, then the first."""
    p = urls.path(F.col(url))
    target = F.concat(F.when(p == "", F.lit("/")).otherwise(p), F.when(urls.query(F.col(url)) != "", F.concat(F.lit("?"), urls.query(F.col(url)))).otherwise(F.lit("")))
    df = pages.join(rules.withColumnRenamed("site", "_site"), pages[site] == F.col("_site"), "left").withColumn("_target", target)
    hits = F.filter("rules", lambda r: (r["pattern"] != "") & F.regexp_like(F.col("_target"), r["regex"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["specificity"], (r["directive"] == "allow").alias("allow"), (-r["pos"]).alias("first"), r["directive"].alias("directive"), r["pattern"].alias("pattern"))))
    df = df.withColumn("_best", best)
    return df.withColumns({"robots_allowed": F.coalesce(F.col("_best.allow"), F.lit(True)), "matched_directive": F.col("_best.directive"), "matched_rule": F.col("_best.pattern")}).drop("_best", "_target", "_site", "rules")


def counts(groups: DataFrame) -> DataFrame:
    """site, groups, rules of parsed robots.txt files (see parse); a file without groups has no row."""
    return groups.groupBy("site").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.size("rules")).cast("long").alias("rules"))
