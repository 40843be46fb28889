"""URL filter by link-graph propagation. DataFrame functions only.

Longest-prefix rules judge the urls that they fit. For the others each host has two scores: trust, personalised
PageRank from hosts that the rules allow, along links; and distrust, the same from hosts that the rules
block, against the links (who links to a blocked host shares in its distrust). A host's seed is the share of
its pages that such rules decide; for a host that is only linked to, the share of the links to it. Both scores are scaled so that a
host without links keeps its seed; a host is blocked if its distrust is at least ``THRESHOLD`` and above its trust.
Propagation ends when no host's score changes by ``TOLERANCE`` any more; without an edge it ends at once.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule. The empty host takes no part
in the graph and is allowed. Null html has no links. Repeated pages keep their rows and count each. Links
that name no host, or their own, are no edges. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import lower_ascii, union, written

#: (verdict, host, path): the rules in force.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, THRESHOLD, TOLERANCE = 0.85, 0.5, 1e-3
_LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?(//[^\"'\s>]+)"


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def apply_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. Rules as long as each other: the first given."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        name = F.when(_fits(host, path, r), r[1] + r[2]).otherwise(name)
        verdict = F.when(_fits(host, path, r), r[0]).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame, rules=RULES) -> DataFrame:
    """(src, dst, ruled, n): the links of each host to other hosts, by the verdict of the rules on them. ``pages`` has host and html."""
    urls = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("url"))
    dst, path = host_path(F.concat(F.lit("link:"), F.col("url")))
    links = urls.select("src", dst.alias("dst"), path.alias("path")).where("dst <> '' AND dst <> src")
    return links.select("src", "dst", apply_rules(F.col("dst"), F.col("path"), rules)[1].alias("ruled")).groupBy("src", "dst", "ruled").agg(F.count(F.lit(1)).alias("n"))


def host_edges(links: DataFrame) -> DataFrame:
    """(src, dst, w): each host's links to other hosts, as shares of its links."""
    n = links.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    total = n.groupBy("src").agg(F.sum("n").alias("all"))
    return n.join(total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("w"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, score) with score = seed + damping * sum over edges (src -> host) of score(src) * w.

    This is personalised PageRank over (1 - damping): a host that nothing reaches keeps its seed. Each round sends on what the
    last one brought, in one join and one partial aggregate, and is written, so that no round computes an earlier one again. All scores
    are sums of what came in the rounds; what a round brings shrinks by ``damping``, which ends them.
    """
    came = written(seeds.select("host", F.col("seed").cast("double").alias("score")).where("score > 0"))
    rounds = [came]
    while True:
        moved = edges.join(came, edges.src == came.host).select(F.col("dst").alias("host"), (F.col("w") * F.col("score") * damping).alias("score"))
        came = written(moved.groupBy("host").agg(F.sum("score").alias("score")))
        if (came.agg(F.max("score")).first()[0] or 0.0) < tolerance:
            break
        rounds.append(came)
    rest = seeds.select("host", F.lit(0.0).alias("score"))
    return union([rest, *rounds]).groupBy("host").agg(F.sum("score").alias("score"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each row of ``pages``."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    name, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "_ruled": verdict})
    links = written(host_links(rows, rules))
    share = lambda ruled, n, v: F.coalesce(F.sum(F.when(F.col(ruled) == v, n)) / F.sum(n), F.lit(0.0)).alias(v)
    hosts = written(rows.where("host <> ''").groupBy("host").agg(*[share("_ruled", F.lit(1), v) for v in ("allow", "block")]))
    linked = links.groupBy(F.col("dst").alias("host")).agg(*[share("ruled", F.col("n"), v) for v in ("allow", "block")]).join(hosts, "host", "left_anti")
    seeds = written(hosts.unionByName(linked))
    edges = written(host_edges(links))
    back = edges.groupBy("dst").agg(F.sum("w").alias("all"))
    against = written(edges.join(back, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("w") / F.col("all")).alias("w")))
    trust = propagate(seeds.select("host", F.col("allow").alias("seed")), edges, damping, tolerance).withColumnRenamed("score", "trust")
    distrust = propagate(seeds.select("host", F.col("block").alias("seed")), against, damping, tolerance).withColumnRenamed("score", "distrust")
    scores = trust.join(distrust, "host", "full").select("host", *[F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in ("trust", "distrust")])
    out = rows.drop("html").join(scores, "host", "left")
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", F.when(blocked, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op10_urls(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
