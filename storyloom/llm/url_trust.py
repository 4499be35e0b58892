"""URL filters: longest-match host rules, then trust and reversed distrust propagated over host links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: (verdict, host, path): production rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Damping, and the distrust from which a host is blocked, in shares of a seed that rules block wholly.
DAMPING, BLOCK_SHARE = 0.85, 0.5
#: Mass that may still be added in all when ranks count as settled, and the most steps.
TOLERANCE, MOST_STEPS = 1e-5, 400
#: Parts that the outgoing links of any one host are dealt to.
SALTS = 32


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as (rule, verdict), null without one. The rules are a constant list: plain conditions."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is the outermost test
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, from absolute and scheme-relative URLs in href and src attributes.

    Relative links stay on their host and carry no trust anywhere.
    """
    targets = F.regexp_extract_all("html", F.lit(r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"'>]+)"""), F.lit(1))
    links = pages.select("host", F.explode(targets).alias("to"))
    links = links.select(F.col("host").alias("src"), ascii_lower(F.regexp_extract("to", "//([^/?#]*)", 1)).alias("dst"))
    return links.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def domain_links(hosts: DataFrame) -> DataFrame:
    """(src, dst, n): both ways between a host and the host one label shorter, where pages exist on both."""
    pairs = hosts.select("host", F.expr("substring(host, instr(host, '.') + 1)").alias("up")).filter("instr(host, '.') > 0 and instr(up, '.') > 0")
    known = hosts.select(F.col("host").alias("up"))
    pairs = pairs.join(known, "up")
    down = pairs.select(F.col("up").alias("src"), F.col("host").alias("dst"), F.lit(1).cast("long").alias("n"))
    return pairs.select(F.col("host").alias("src"), F.col("up").alias("dst"), F.lit(1).cast("long").alias("n")).unionByName(down)


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """(host, mass): personalised PageRank of `seeds` (host, seed) over `edges` (src, dst, n), n the link's weight.

    mass = (1 - damping) * seed + damping * what links pass on. A host without links passes nothing on. Steps start from
    (1 - damping) * seed, so mass only grows, and end when all that later steps could add is below TOLERANCE; an error is
    raised if MOST_STEPS do not settle it. With `rounds` that many steps run from the seeds instead. Links of one
    host are salted, and sums are partial before their shuffle, so hubs of either direction spread over tasks.
    """
    out_sum = edges.groupBy("src").agg(F.sum("n").alias("total"))
    share = edges.join(out_sum, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w"), F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int").alias("salt"))
    share = materialize(share, "links")
    kept = seeds.select("host", ((1 - damping) * F.col("seed")).alias("mass"))
    if not share.limit(1).count():
        return kept
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))

    def step(now: DataFrame) -> DataFrame:
        given = now.filter("mass > 0").withColumn("salt", salts)
        moved = share.join(given.withColumnRenamed("host", "src"), ["src", "salt"]).select(F.col("dst").alias("host"), (damping * F.col("w") * F.col("mass")).alias("mass"))
        return kept.unionByName(moved).groupBy("host").agg(F.sum("mass").alias("mass"))

    if rounds is not None:
        now = seeds.select("host", F.col("seed").alias("mass"))
        for _ in range(rounds):
            now = materialize(step(now), "ranks")
        return now
    total = lambda df: df.agg(F.sum("mass")).first()[0] or 0.0
    now, before = kept, total(kept)
    for _ in range(MOST_STEPS):
        now = materialize(step(now), "ranks")
        after = total(now)
        if (after - before) * damping / (1 - damping) < TOLERANCE:  # each change is at most damping times the one before
            return now
        before = after
    raise RuntimeError(f"ranks are not settled after {MOST_STEPS} steps")


def judge_hosts(parsed: DataFrame, domains: bool = False) -> DataFrame:
    """(host, trust, distrust, blocked) from pages with page-level rule verdicts.

    Edges are the links that pages hold. domains: also both ways between a host and its parent domain, which no page
    states; off in production.

    A host is a trusted seed by the share of its pages that a rule allows, and a blocked seed by the share that a rule
    blocks. Trust flows along links; distrust flows against them, from blocked hosts to those that link there. A host is
    blocked if it has more distrust than trust, and more than BLOCK_SHARE of what a wholly blocked seed has by itself;
    unreached hosts are allowed.
    """
    seeds = parsed.groupBy("host").agg(F.avg(F.when(F.col("rule_verdict") == "allow", 1.0).otherwise(0.0)).alias("good"), F.avg(F.when(F.col("rule_verdict") == "block", 1.0).otherwise(0.0)).alias("bad"))
    seeds = materialize(seeds.filter("host <> ''"), "hosts")
    edges = host_links(parsed)
    if domains:
        edges = edges.unionByName(domain_links(seeds)).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    edges = materialize(edges, "edges")
    trust = personalised_rank(edges, seeds.select("host", F.col("good").alias("seed")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_rank(back, seeds.select("host", F.col("bad").alias("seed"))).withColumnRenamed("mass", "distrust")
    both = trust.withColumnRenamed("mass", "trust").join(distrust, "host", "full_outer").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    return both.withColumn("blocked", (F.col("distrust") > F.col("trust")) & (F.col("distrust") > BLOCK_SHARE * (1 - DAMPING)))


def judge_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    A url's rule decides where one fits; other pages take their host's verdict. Null urls and those without `://` have
    an empty host and path, fit no rule and are allowed. Null html has no links. Repeated rows come out alike; an empty
    table gives none; very long urls and pages are read whole; other columns, of any name, don't matter. Only DataFrame
    functions run.
    """
    url = F.col("url").cast("string")
    page = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), F.col("html").cast("string").alias("html"))
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    page = page.select("page_id", "host", "path", "html", rule.alias("rule"), verdict.alias("rule_verdict"))
    hosts = materialize(judge_hosts(page).filter("blocked").select(F.col("host").alias("bad_host")), "blocked")
    out = page.drop("html").join(hosts, F.col("host") == F.col("bad_host"), "left")
    final = F.coalesce("rule_verdict", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", final.alias("verdict"))
