"""URL filters: fixed rules, and trust spread over links between hosts.

A rule is a host and the start of a path; it fits the host and its subdomains, and
the longest fitting rule decides. Where none fits, the host decides: trust starts
from hosts in proportion to their pages that rules allow and follows links forward;
distrust starts from hosts in proportion to their pages that rules block and follows
links backward, to hosts that link there. Both are personalised PageRank over
aggregated host edges (a relative link is one from the host to itself, as is the whole
weight of a host without links). A host is blocked if over ``THRESHOLD`` of its trust and
distrust together is distrust, and it has at least ``LEAST`` of the mean distrust of all
hosts. Neither depends on how many hosts there are; a host that links to one blocked host
which far more hosts link to than is usual may still stay under the least.

Pages are summed to hosts and host pairs before any shuffle; the iterations only see
those. Host tables are joined on the host with the adaptive split of hot hosts.

Nulls and odd input: a url that is null or has no ``://`` has an empty host and path
and is allowed unless its host-less group is blocked by the method; null html has no
links; repeated pages count as often as they occur; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import common

RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
]
DAMPING = 0.7
ROUNDS = 12
THRESHOLD = 0.5
LEAST = 0.1
#: Rows of host tables in a partition.
ROWS = 200_000

_LINK = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """Lower-cased host of a url, empty if it has none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(found)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each distinct host the rules of it and its parents, longest first."""
    dots = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(dots)),
        lambda n: F.array_join(F.slice(dots, n, F.size(dots)), "."),
    )
    each = hosts.where("host <> ''").select("host", F.explode(parents).alias("of"))
    rule = F.col("rule")
    parts = rules.select(
        F.substring_index(rule, "/", 1).alias("of"), "action", "rule",
        F.expr("substr(rule, instr(rule, '/'))").alias("start"),
    )
    fits = each.join(parts, "of").groupBy("host").agg(
        F.sort_array(
            F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "start", "action")),
            asc=False,
        ).alias("rules")
    )
    return fits


def deciding(path: Column, rules: Column) -> Column:
    """The longest of a host's rules whose path starts ``path``, or null."""
    return F.get(F.filter(rules, lambda r: path.startswith(r["start"])), F.lit(0))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between hosts, counted over all pages."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))
    each = pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link"))
    target = (
        F.when(F.col("link").startswith("//"), host_of(F.concat(F.lit("http:"), "link")))
        .when(F.col("link").rlike(r"^(?i)https?://"), host_of(F.col("link")))
        .when(F.col("link").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(""))
        .otherwise(F.col("src"))
    )
    return (
        each.select("src", target.alias("dst")).where("src <> '' and dst <> ''")
        .groupBy("src", "dst").agg(F.count("*").alias("links"))
    )


def propagate(
    edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING
) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trusted, blocked: shares from 0 to 1)."""
    hosts = seeds.select("host").unionByName(edges.select(F.col("src").alias("host"))).unionByName(
        edges.select(F.col("dst").alias("host"))
    ).distinct()
    start = common.cut_lineage(
        hosts.join(seeds, "host", "left").select(
            "host", F.coalesce("trusted", F.lit(0.0)).alias("trusted"),
            F.coalesce("blocked", F.lit(0.0)).alias("blocked"),
        )
    )
    # Every round writes these tables anew: as many files as their rows are worth.
    few = 1 + (start.count() + edges.count()) // ROWS

    def weighed(source: str, target: str) -> DataFrame:
        total = edges.groupBy(source).agg(F.sum("links").alias("total"))
        real = edges.join(total, source).select(
            F.col(source).alias("host"), F.col(target).alias("to"),
            (F.col("links") / F.col("total")).alias("weight"),
        )
        alone = start.join(total, start["host"] == total[source], "left_anti").select(
            "host", F.col("host").alias("to"), F.lit(1.0).alias("weight")
        )
        return real.unionByName(alone)

    forward = common.cut_lineage(weighed("src", "dst").coalesce(few))
    backward = common.cut_lineage(weighed("dst", "src").coalesce(few))
    start = start.coalesce(few)
    scores = start.select("host", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust"))
    for _ in range(rounds):
        ahead = forward.join(scores, "host").select(
            F.col("to").alias("host"), (F.col("trust") * F.col("weight")).alias("t"),
            F.lit(0.0).alias("d"),
        )
        back = backward.join(scores, "host").select(
            F.col("to").alias("host"), F.lit(0.0).alias("t"),
            (F.col("distrust") * F.col("weight")).alias("d"),
        )
        came = ahead.unionByName(back).groupBy("host").agg(
            F.sum("t").alias("t"), F.sum("d").alias("d")
        )
        scores = common.cut_lineage(
            start.join(came, "host", "left").select(
                "host",
                ((1 - damping) * F.col("trusted") + damping * F.coalesce("t", F.lit(0.0)))
                .alias("trust"),
                ((1 - damping) * F.col("blocked") + damping * F.coalesce("d", F.lit(0.0)))
                .alias("distrust"),
            ).coalesce(few)
        )
    return scores


def judge(pages: DataFrame, rules: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    parsed = pages.select(
        F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
    )
    by_host = common.cut_lineage(rules_by_host(parsed.select("host").distinct(), rules))
    ruled = common.cut_lineage(
        parsed.join(by_host, "host", "left").withColumn(
            "fit", deciding(F.col("path"), F.col("rules"))
        ).select(
            "page_id", "host", "path", F.col("fit.rule").alias("rule"),
            F.col("fit.action").alias("action"),
        )
    )
    seeds = ruled.where("host <> ''").groupBy("host").agg(
        F.avg((F.coalesce("action", F.lit("")) == "allow").cast("double")).alias("trusted"),
        F.avg((F.coalesce("action", F.lit("")) == "block").cast("double")).alias("blocked"),
    )
    scores = propagate(common.cut_lineage(host_edges(pages)), seeds)
    mean = scores.agg(F.avg("distrust")).first()[0] or 0.0
    share = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    bad = F.coalesce(share & (F.col("distrust") >= LEAST * mean), F.lit(False))
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        "trust", "distrust",
    )
