"""robots.txt as data: groups of agents with ordered rules, and the verdict per URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import urls as U
from shelfmark.functions.text import percent_decode, strip
from shelfmark.operators.spread import spread_lookup

LINE_BREAK = r"\r\n|[\n\r]"
RULES_TYPE = "array<struct<rule_no:bigint,allow:boolean,prefix:string>>"


def _readable(robots: DataFrame) -> DataFrame:
    return robots.filter(F.col("status_code").between(200, 299)) if "status_code" in robots.columns else robots


def _lines(robots: DataFrame) -> DataFrame:
    return _readable(robots).select("host", F.posexplode(F.split("body", LINE_BREAK)).alias("line_no", "line"))


def robots_sitemaps(robots: DataFrame, keep_empty: bool = False) -> DataFrame:
    """``Sitemap:`` directives in file order: ``host, pos, sitemap_url``."""
    declared = _lines(one_file(robots)).filter(F.lower(strip(F.col("line"))).startswith("sitemap:"))
    found = declared.select(
        "host",
        F.col("line_no").cast("bigint").alias("pos"),
        strip(F.regexp_extract("line", r"(?s)^[^:]*:(.*)\z", 1)).alias("sitemap_url"),
    )
    return found if keep_empty else found.filter(F.col("sitemap_url") != "")


def one_file(robots: DataFrame) -> DataFrame:
    """One robots file per host: the newest by ``fetched_at`` where there is such a column, else the one that
    sorts last by status and body."""
    order = [c for c in ("fetched_at", "status_code", "body") if c in robots.columns]
    last = F.max(F.struct(*order)).alias("_file")
    return robots.groupBy("host").agg(last).select("host", "_file.*")


def robots_groups(robots: DataFrame) -> DataFrame:
    """Groups in file order: ``host, group_no, agents, rules``.

    A blank line ends a group, an agent line after a rule starts the next one, and rules
    before any agent line do not count. The windows cover the lines of one file.
    """
    text = F.regexp_replace("line", r"(?s)#.*", "")
    name = F.lower(strip(F.regexp_extract(text, r"^([^:]*):", 1)))
    value = percent_decode(strip(F.regexp_extract(text, r"(?s)^[^:]*:(.*)\z", 1)))
    kind = (
        F.when(F.col("line") == "", "blank")
        .when(name == "user-agent", "agent")
        .when(name.isin("allow", "disallow", "crawl-delay", "request-rate"), "rule")
    )
    events = (
        _lines(one_file(robots))
        .select("host", "line_no", kind.alias("kind"), name.alias("name"), value.alias("value"))
        .filter(F.col("kind").isNotNull())
    )
    by_file = Window.partitionBy("host").orderBy("line_no")
    in_block = Window.partitionBy("host", "block").orderBy("line_no")
    before = F.lag("kind").over(in_block)
    opens = (F.col("kind") == "agent") & (before.isNull() | (before != "agent"))
    numbered = (
        events.withColumn("block", F.sum((F.col("kind") == "blank").cast("int")).over(by_file))
        .filter(F.col("kind") != "blank")
        .withColumn("agents_so_far", F.count_if(F.col("kind") == "agent").over(in_block))
        .withColumn("opens", opens.cast("int"))
        .filter(F.col("agents_so_far") > 0)
        .withColumn("group_no", F.sum("opens").over(by_file))
    )
    is_rule = F.col("name").isin("allow", "disallow")
    rule = F.struct(
        F.col("line_no").cast("bigint").alias("rule_no"),
        ((F.col("name") == "allow") | (F.col("value") == "")).alias("allow"),
        F.regexp_replace("value", r"[?#]+\z", "").alias("prefix"),
    )
    return (
        numbered.groupBy("host", "group_no")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("kind") == "agent", F.lower("value")))).alias("agents"),
            F.array_sort(F.collect_list(F.when(is_rule, rule))).alias("rules"),
            F.count_if(F.col("kind") == "rule").alias("n_rules"),
        )
        .filter(F.col("n_rules") > 0)
        .select("host", F.col("group_no").cast("bigint").alias("group_no"), "agents", "rules")
    )


def robots_rules(robots: DataFrame) -> DataFrame:
    """One row per agent and rule: ``host, group_no, agent, rule_no, allow, prefix``."""
    return (
        robots_groups(robots)
        .select("host", "group_no", F.explode("agents").alias("agent"), "rules")
        .select("host", "group_no", "agent", F.inline("rules"))
    )


def agent_policy(robots: DataFrame, agent: str) -> DataFrame:
    """What each robots file says to one agent: ``host, policy, rules``, a row per host.

    The first group naming the agent counts, else the first ``*`` group. A file that may not
    be read (401, 403) denies all, other client errors allow all, and a server error leaves
    the host ``unknown``.
    """
    robots = one_file(robots)
    token = agent.split("/")[0].lower()
    groups = robots_groups(robots).withColumn("any_agent", F.array_contains("agents", "*"))
    named = F.exists("agents", lambda a: F.lit(token).contains(a))
    chosen = (
        groups.filter(F.col("any_agent") | named)
        .groupBy("host")
        .agg(F.min_by("rules", F.struct("any_agent", "group_no")).alias("rules"))
    )
    code = F.col("status_code") if "status_code" in robots.columns else F.lit(200)
    policy = (
        F.when(code.between(200, 299), "rules")
        .when(code.isin(401, 403), "deny")
        .when(code.between(400, 499), "allow")
        .otherwise("unknown")
    )
    return robots.select("host", policy.alias("policy")).join(chosen, "host", "left")


def allowed_by(url: Column, policy: Column, rules: Column, on_missing: str) -> Column:
    """The first rule, in file order, whose prefix the URL has; allowed when none has.
    Wildcards are literal text, also a lone ``*``."""
    target = F.regexp_replace(U.request_target(percent_decode(url)), r"[?#]+\z", "")
    hits = F.filter(rules, lambda r: target.startswith(r["prefix"]))
    verdict = F.coalesce(F.get(hits, F.lit(0))["allow"], F.lit(True))
    known = F.coalesce(policy, F.lit("unknown"))
    return (
        F.when(known == "rules", verdict)
        .when(known == "deny", F.lit(False))
        .when(known == "allow", F.lit(True))
        .otherwise(F.lit(on_missing == "allow"))
    )


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str, on_missing: str = "allow") -> DataFrame:
    """``urls`` with a column ``allowed``. Hosts may own any share of the URLs."""
    looked_up = spread_lookup(
        urls.withColumn("host", U.netloc(F.col("url"))), agent_policy(robots, agent), ["host"], spread_by=["url"]
    )
    verdict = allowed_by(F.col("url"), F.col("policy"), F.col("rules"), on_missing)
    return looked_up.withColumn("allowed", verdict).select(*urls.columns, "allowed")
