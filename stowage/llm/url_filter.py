"""URL filters by rules and by trust and distrust over the link graph, in DataFrame functions only.

A rule (host, path prefix) fits its host and all subdomains; the longest rule that fits decides. Other
urls go by their host's standing: personalised PageRank from the hosts of allowed pages along the
edges (trust), and from the hosts of blocked pages against them (distrust). A host is blocked whose
distrust exceeds its trust by THRESHOLD; one that neither reaches is allowed.

Ranks begin with what the seeds keep to themselves and only grow: a round sends on what the one before
it added. Rounds go on until none adds more than SETTLED of any host's rank, so that no host that a
walk can reach is left out, and what is still to come is about as small a share.

Edges are the hyperlinks of pages between hosts, and, with a smaller weight, those between a host and
the domain above it, which share an owner. Domains right above a host of SUFFIXES, where strangers
register, share none with it. The graph is one of hosts: the pages of a host, however many, are counted
before anything meets.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is
allowed; a null html has no links; an html of any length is one row; repeated rows, and rows that share
a page_id, are judged by their urls, equal ones alike, and count each for their host; hosts of equal
trust and distrust are allowed; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import Written

#: (verdict, rule): host, then path from its first "/".
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Share of a host's rank that goes on, the share of a rank that a round adds to none when ranks have settled, rounds between two writes, and how far distrust may exceed trust.
DAMPING, SETTLED, WRITE_EVERY, THRESHOLD = 0.85, 0.01, 4, 1.0
#: Domains of two labels below which anyone may register (fixed values, some of the public list).
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "co.in", "co.za",
    "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "tumblr.com", "herokuapp.com", "netlify.app", "vercel.app", "pages.dev", "web.app", "appspot.com",
)
#: Weight of the edges between a host and the domain above it, a hyperlink being 1.
FAMILY = 0.5
#: The host of an absolute link in a page.
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*(?:https?:)?//([^/\"'?#\s>]+)"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = None, None
    for says, text in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith(f".{text[:at]}")) & path.startswith(text[at:])
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and weight of the graph of hosts, from pages (host, html)."""
    linked = pages.where(F.col("html").contains("//")).select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    linked = linked.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    linked = Written(linked, "links").df
    hosts = pages.select("host").union(linked.select("dst")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    tail = lambda k: F.array_join(F.slice("l", k, F.size("l")), ".")
    # Each domain above a host, down to its owner's, with the one below it. An owner has two labels, below a suffix three.
    above = hosts.select(labels.alias("l")).where(F.size("l") > 2)
    above = above.withColumn("_own", F.when(tail(F.size("l") - 1).isin(*SUFFIXES), 3).otherwise(2)).where(F.size("l") > F.col("_own"))
    above = above.select("l", F.explode(F.sequence(F.lit(1), F.size("l") - F.col("_own"))).alias("k"))
    family = above.select(tail(F.col("k")).alias("src"), tail(F.col("k") + 1).alias("dst")).distinct().withColumn("weight", F.lit(FAMILY))
    back = family.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return linked.unionByName(family).unionByName(back).where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, settled: float = SETTLED) -> DataFrame:
    """host, trust and distrust from `edges` (src, dst, weight) and `seeds` (host, allowed, blocked: numbers of pages).

    Ranks are in pages, not shares of a whole, so that trust and distrust can be held against each other.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "weight"))
    out = Written(both.groupBy("kind", "src").agg(F.sum("weight").alias("_out")), "host-out").df
    both = Written(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("_out")).alias("share")), "host-edges").df
    start = seeds.select(F.lit("trust").alias("kind"), "host", F.col("allowed").alias("n")).union(seeds.select(F.lit("distrust"), F.col("host"), F.col("blocked"))).where("n > 0")
    own = F.col("n").cast("double") * (1 - DAMPING)
    held = Written(start.select("kind", "host", own.alias("rank"), own.alias("added")), "host-ranks")
    while True:
        ranks = held.df
        for _ in range(WRITE_EVERY):
            sent = ranks.select("kind", F.col("host").alias("src"), "added").join(both, ["kind", "src"]).select("kind", F.col("dst").alias("host"), F.lit(0.0).alias("rank"), (F.col("added") * F.col("share") * DAMPING).alias("added"))
            ranks = sent.union(ranks.select("kind", "host", "rank", F.lit(0.0))).groupBy("kind", "host").agg((F.sum("rank") + F.sum("added")).alias("rank"), F.sum("added").alias("added"))
        new = Written(ranks, "host-ranks")
        held.drop()
        held = new
        most = held.df.agg(F.max(F.col("added") / F.col("rank"))).first()[0]
        if most is None or most <= settled:
            break
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    return held.df.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule and verdict, with the host's trust and distrust, a row for each of `pages`."""
    named = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = Written(named.select("page_id", "host", "path", rule.alias("rule"), said.alias("_said")), "urls").df
    count = lambda verdict: F.sum(F.when(F.col("_said") == verdict, 1).otherwise(0))
    seeds = rows.where("host <> ''").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked"))
    standing = propagate(host_edges(named.select("host", "html")), seeds)
    standing = Written(standing, "host-standing").df
    # Rounded, so that the order of sums can't decide where both are equal.
    standing = standing.select("host", *[F.round(c, 9).alias(c) for c in ("trust", "distrust")])
    block = F.col("distrust") > F.col("trust") * threshold
    verdict = F.coalesce("_said", F.when(block, "block"), F.lit("allow"))
    return rows.join(standing, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def url_table(pages: DataFrame) -> DataFrame:
    """The digest columns, a row for each of `pages`."""
    return judge_urls(pages.select("page_id", "url", "html"))
