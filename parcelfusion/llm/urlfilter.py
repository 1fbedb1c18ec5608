"""URL filtering: prefix rules first, then trust and distrust spread over the host graph.

A page that a rule fits takes the longest rule's verdict. Its host becomes a seed, weighed by its pages:
of trust if the rule allows, of distrust if it blocks. Personalised PageRank carries trust along host
edges and distrust against them, until the part of the walk that is still to come can change no verdict
(what reaches a host without edges stays there); a page without a rule takes its host's verdict, blocked where trust is
under ``threshold`` of the two together. A host that neither reaches is allowed.

Host edges are the absolute and scheme-relative links of the pages, and both ways between a host and its parent domain (two
labels at least), as crawls with site-relative links only have no other edges. Every step is a DataFrame
join or a pre-aggregated sum; a hub's edges can be split by adaptive execution.

Edge cases: a null url, or one without "://", has empty host and path, fits no rule and is allowed; null
html has no links; repeated rows count as pages each; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, sized_join, stored

#: Shares this near the threshold are at it: sums of doubles in another order may differ by less.
NEAR = 5e-7
#: (verdict, host, path prefix)
Rule = tuple[str, str, str]

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
LINK = r"(?i)href\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'>\s]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def ruled(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``pages`` (host, path, ...) with rule and verdict of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("verdict", verdict)


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """src, dst, links: links between different hosts, and between hosts and their parent domains."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.transform(found, lambda h: F.translate(h, UPPER, LOWER))).alias("dst"))
    links = links.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("links"))
    linked = stored(links, "url-links")
    labels = F.split("host", r"\.")
    steps = F.explode(F.sequence(F.lit(1), F.size(labels) - 2)).alias("k")
    every = hosts.select("host").union(linked.select("dst")).distinct().where(F.size(labels) > 2)
    chain = every.select(labels.alias("labels"), steps)
    name = lambda k: F.array_join(F.slice("labels", k, F.size("labels")), ".")
    kin = chain.select(name(F.col("k")).alias("src"), name(F.col("k") + 1).alias("dst")).distinct()
    both = kin.unionByName(kin.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("links", F.lit(1.0))
    return linked.unionByName(both).groupBy("src", "dst").agg(F.sum("links").alias("links"))


def spread(seeds: DataFrame, edges: DataFrame, threshold: float, damping: float, most: int = 200) -> DataFrame:
    """host, trust, distrust of the hosts that the seeds (host, trust, distrust, each summing to 1) reach, walked until every verdict is proven.

    After k steps what has arrived at a host is less than its final rank by damping^(k + 1) at most, whatever the graph. So trust over both lies between two bounds; the walk
    ends once these lie on one side of the threshold for every host and no further host is reached, or after ``most`` steps, when damping^k is below 1e-14 and doubles hold no more.
    """
    out_sum = edges.groupBy("src").agg(F.sum("links").alias("out"))
    in_sum = edges.groupBy("dst").agg(F.sum("links").alias("in"))
    e = edges.join(out_sum.hint("merge"), "src").join(in_sum.hint("merge"), "dst")
    ways = e.select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("links") / F.col("out")).alias("t"), F.lit(0.0).alias("d"))
    ways = ways.unionByName(e.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("links") / F.col("in")).alias("d")))
    ways = stored(ways.groupBy("host", "to").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "url-ways")
    start = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    ranks, left, reached = start, damping, -1
    for k in range(1, most + 1):
        sent = ways.join(ranks.hint("merge"), "host").select(
            F.col("to").alias("host"), (F.col("t") * F.col("trust") * damping).alias("trust"), (F.col("d") * F.col("distrust") * damping).alias("distrust")
        )
        ranks = sent.unionByName(start).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        left *= damping
        if k % 4 == 0 or k == most:
            ranks = stored(ranks, "url-ranks")
            low = F.col("trust") / (F.col("trust") + F.col("distrust") + left)
            high = (F.col("trust") + left) / (F.col("trust") + F.col("distrust") + left)
            line = F.lit(threshold - NEAR)
            hosts, open_ = ranks.agg(F.count("*"), F.count_if(~((low >= line) | (high < line)))).first()
            if hosts == reached and open_ == 0:
                break
            reached = hosts
    return ranks


def url_filter(pages: DataFrame, rules: Sequence[Rule], threshold: float = 0.5, damping: float = 0.85) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict. A host whose trust over trust and distrust is within 5e-7 of the threshold, or above, is allowed."""
    judged = ruled(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    count = lambda says: F.sum(F.when(F.col("verdict") == says, 1.0).otherwise(0.0))
    hosts = stored(judged.where("host <> ''").groupBy("host").agg(count("allow").alias("trust"), count("block").alias("distrust")), "url-hosts")
    edges = stored(host_edges(pages, hosts), "url-edges")
    total = hosts.agg(F.sum("trust").alias("all_trust"), F.sum("distrust").alias("all_distrust"))  # one row
    share = lambda c: F.when(F.col(f"all_{c}") > 0, F.col(c) / F.col(f"all_{c}")).otherwise(0.0).alias(c)
    seeds = stored(hosts.where("trust + distrust > 0").crossJoin(F.broadcast(total)).select("host", share("trust"), share("distrust")), "url-seeds")
    ranks = spread(seeds, edges, threshold, damping)
    bad = F.col("trust") / (F.col("trust") + F.col("distrust")) < threshold - NEAR
    blocked = stored(ranks.where((F.col("trust") + F.col("distrust") > 0) & bad).select("host", F.lit("block").alias("spread")), "url-blocked")
    found = sized_join(judged, blocked, "host", "left", blocked.count())
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", "spread", F.lit("allow")).alias("verdict"))
