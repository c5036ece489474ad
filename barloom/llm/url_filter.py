"""URL filters: rules for hosts and paths, and trust propagated over links between hosts.

A url that a rule fits gets the verdict of the longest such rule. The others get that of their host:
personalised PageRank spreads trust along links from hosts with allowed pages, and distrust against
the links from hosts with blocked pages, since who links to bad hosts is suspect. A host is blocked
if it holds at least ``least`` of the distrust that an even share would be and more distrust than
trust. A subdomain counts as linking to the domain above it.

Everything is DataFrame code. Links are summed by pair of hosts before they are shuffled on, so a
host with a third of all pages is as many rows as it has linked hosts; both walks are one table.

Defined cases: null urls and urls without ``://`` have empty host and path, and hosts without
evidence are allowed; null html has no links; repeated pages count as often as they come; an empty
table gives an empty result; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .words import free_name

# Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LINK = r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
STEPS = 8
DAMPING = 0.85
BROADCAST_HOSTS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(source, target, links) between different hosts, subdomains linking upwards included."""
    own = host_of(F.col(url))
    targets = F.transform(
        F.filter(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)),
                 lambda u: u.contains("://") | u.startswith("//")),
        lambda u: F.translate(F.regexp_extract(u, r"^(?:[^/?#]*:)?//([^/?#]*)", 1), _UPPER, _LOWER))
    linked = pages.select(own.alias("source"), F.explode(targets).alias("target"))
    hosts = pages.select(own.alias("source")).distinct()
    above = F.when(F.length("source") - F.length(F.replace("source", F.lit("."), F.lit(""))) >= 2,
                   F.regexp_replace("source", r"^[^.]*\.", ""))
    upward = hosts.select("source", above.alias("target"))
    return linked.unionByName(upward) \
        .filter((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target"))) \
        .groupBy("source", "target").agg(F.count(F.lit(1)).alias("links"))


def propagate(links: DataFrame, seeds: DataFrame, *, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) after ``steps`` steps from seeds (host, trust, distrust)."""
    both = links.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "links") \
        .unionByName(links.select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "links"))
    total = both.groupBy("kind", "host").agg(F.sum("links").alias("total"))
    edges = stage(both.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("total")).alias("share")))
    start = stage(seeds.select(F.lit("trust").alias("kind"), "host", F.col("trust").alias("rank"))
                  .unionByName(seeds.select(F.lit("distrust").alias("kind"), "host", F.col("distrust").alias("rank")))
                  .filter("rank > 0"))
    rank = start
    for step in range(steps):
        moved = rank.join(edges, ["kind", "host"]).select(
            "kind", F.col("to").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        rank = start.withColumn("rank", F.col("rank") * (1 - damping)).unionByName(moved) \
            .groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if step % 4 == 3 or step == steps - 1:
            rank = stage(rank)
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(part("trust"), part("distrust"))


def judge(pages: DataFrame, *, url: str = "url", html: str = "html", rules: tuple = RULES, least: float = 0.05,
          into: str = "judged") -> DataFrame:
    """``pages`` with a struct column: host, path, rule and verdict."""
    seen = pages.select(host_of(F.col(url)).alias("host"), rule_for(host_of(F.col(url)), path_of(F.col(url)), rules).alias("r"))
    share = lambda verdict: F.avg(F.when(F.col("r.verdict") == verdict, 1.0).otherwise(0.0))
    hosts = stage(seen.filter("host != ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")))
    n, allowed, blocked = hosts.agg(F.count(F.lit(1)), F.sum("allowed"), F.sum("blocked")).first()
    seeds = hosts.select("host", (F.col("allowed") / float(allowed or 1)).alias("trust"),
                         (F.col("blocked") / float(blocked or 1)).alias("distrust"))
    ranks = propagate(host_links(pages, url, html), seeds)
    bad = ranks.filter((F.col("distrust") * n >= least) & (F.col("distrust") > F.col("trust"))).select("host")
    bad = stage(bad.join(hosts.select("host"), "host", "left_semi"))
    name, path, rule, mark = (free_name(pages, c) for c in ("host_name", "path_name", "rule_name", "host_is_bad"))
    bad = bad.select(F.col("host").alias(name), F.lit(True).alias(mark))
    if bad.count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    return (
        pages.withColumns({name: host_of(F.col(url)), path: path_of(F.col(url))})
        .withColumn(rule, rule_for(F.col(name), F.col(path), rules)).join(bad, name, "left")
        .select(*[F.col(c) for c in pages.columns], F.struct(
            F.col(name).alias("host"), F.col(path).alias("path"), F.col(f"{rule}.rule").alias("rule"),
            F.coalesce(f"{rule}.verdict", F.when(F.col(mark), "block").otherwise("allow")).alias("verdict")).alias(into))
    )
