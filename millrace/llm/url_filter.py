"""URL filter: rules on hosts and paths, and link-graph propagation for the pages that no rule fits.

Trust is a personalised PageRank from the hosts that allow rules fit, along the links between hosts; distrust is the
same from the hosts that block rules fit, against the direction of links (a host that links to bad ones is bad). A host
is blocked when its distrust exceeds its trust by a factor. Links are gathered to host edges before anything iterates.

The rank that a host without links holds is dropped on the way, more of it in one direction than in the other; so trust and
distrust are each scaled to sum 1 before they are compared. After ``STEPS`` steps at most DAMPING ** STEPS (a fifth) of a
seed's rank could still move on, and only to hosts over ten links away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch

#: (verdict, host, path) of the fixed rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
STEPS, DAMPING, FACTOR = 10, 0.85, 1.0


def host_of(url: Column) -> Column:
    """What stands after the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith("." + domain)


def _longest(rules) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits host and path; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, domain, start in reversed(_longest(rules)):
        here = _fits(host, domain) & path.startswith(start)
        name, verdict = F.when(here, domain + start).otherwise(name), F.when(here, v).otherwise(verdict)
    return name, verdict


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts. A link without :// stays on its page's host and makes no edge."""
    links = F.regexp_extract_all("html", F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    out = pages.where("html LIKE '%://%'").select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(links)).alias("link"))
    out = out.where(F.col("link").contains("://")).select("src", host_of(F.col("link")).alias("dst"))
    return out.where("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _rank(scratch: Scratch, name: str, links: DataFrame, seeds: DataFrame, steps: int, damping: float) -> DataFrame:
    """(host, rank) of hosts reached: rank = (1 - damping) * seed share + damping * what links pass on, ``steps`` times.

    links: (a, b, share), where a passes that share of its rank to b; a host without links keeps nothing for others.
    """
    rank = scratch.save(seeds.select("host", F.col("share").alias("rank")), f"{name}-0")
    for k in range(1, steps + 1):
        passed = rank.join(links, rank.host == links.a).groupBy("b").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        both = passed.select(F.col("b").alias("host"), (F.lit(damping) * F.col("got")).alias("rank")).unionByName(seeds.select("host", ((1 - damping) * F.col("share")).alias("rank")))
        rank = scratch.save(both.groupBy("host").agg(F.sum("rank").alias("rank")), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    return rank


def _seeds(hosts: DataFrame, column: str) -> DataFrame:
    """(host, share): the hosts where the column is true, each with its part of all their pages."""
    found = hosts.where(F.col(column) & (F.col("host") != ""))
    total = found.agg(F.sum("n")).first()[0] or 1
    return found.select("host", (F.col("n") / F.lit(float(total))).alias("share"))


def host_scores(pages: DataFrame, rules=RULES, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of every host that propagation reaches, each of sum 1. pages has url and html; nulls make no links.

    Rules may fit some pages of a host only: it is a blocked seed when they block over half of its pages, and a trusted
    seed when they allow more of them than they block.
    """
    scratch = Scratch(pages.sparkSession, "hosts")
    _, said = ruled(F.col("host"), F.col("path"), rules)
    judged = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select("host", said.alias("said"))
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad"))
    hosts = scratch.save(hosts.select("host", "n", (F.col("good") > F.col("bad")).alias("trusted"), (2 * F.col("bad") > F.col("n")).alias("blocked")), "hosts")
    graph = scratch.save(edges(pages), "edges")
    if not graph.head(1):
        steps = 0

    def shares(a: str, b: str) -> DataFrame:
        out = graph.groupBy(a).agg(F.sum("n").alias("all"))
        return graph.join(out, a).select(F.col(a).alias("a"), F.col(b).alias("b"), (F.col("n") / F.col("all")).alias("share"))

    ranks = []
    for name, ends, seed in (("trust", ("src", "dst"), "trusted"), ("distrust", ("dst", "src"), "blocked")):
        links = scratch.save(shares(*ends), f"links-{name}")
        rank = _rank(scratch, name, links, _seeds(hosts, seed), steps, damping)
        whole = rank.agg(F.sum("rank")).first()[0] or 1.0
        ranks.append(rank.select("host", (F.col("rank") / F.lit(whole)).alias(name)))
    zero = F.lit(0.0)
    return ranks[0].join(ranks[1], "host", "full").select("host", F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, steps: int = STEPS, damping: float = DAMPING, factor: float = FACTOR) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, trust, distrust.

    pages has page_id, url and html; other columns are ignored. A null url, or one without ://, has an empty host and
    path, no rule and the verdict allow. The longest rule that fits gives the verdict; without one, a host whose
    distrust exceeds ``factor`` times its trust is blocked and any other is allowed. Repeated rows get a row each.
    """
    url = F.col("url")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    scores = host_scores(pages, rules, steps, damping)
    scored = own.select("*", name.alias("rule"), verdict.alias("said")).join(scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(distrust > factor * trust, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; contract of judge()."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
