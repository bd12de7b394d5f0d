"""URL filter: stated rules first, then trust and distrust spread over the host link graph.

Rules name a host and a path. A rule fits its host and all subdomains when the url's path starts
with the rule's; the longest wins. Urls without a rule are judged by their host. Host edges are the
links of pages to other hosts. Personalised PageRank carries trust forward from hosts of allowed
pages and, on the reversed edges, distrust back to the hosts that link to blocked ones; pages
without a rule are the neutral mass. A host is blocked when distrust is more than a stated share of
all that reaches it.

Defined cases: a url that is null or has no ``://`` has an empty host and path, no rule, and is
allowed; null or empty html has no links; repeated rows count as pages of their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import class_counts, join_classes, stored

#: (verdict, host/path)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, tail = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, links): links between different hosts, counted map-side first."""
    found = pages.select(url_host(F.col(url)).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(_LINK), F.lit(1)))).alias("link"))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    edges = found.select("src", url_host(absolute).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return stored(edges.groupBy("src", "dst").agg(F.count("*").alias("links")), "host-links")


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, rounds: int = 100) -> DataFrame:
    """(host, trust, distrust, neutral) from seeds of the same columns over (src, dst, links).

    Trust and the neutral mass follow links, distrust goes against them; each spreads in proportion
    to the links. Rounds go on until what moves is less than ``tolerance`` of all mass. Hosts with
    very many links are joined by broadcast, so their edges stay spread.
    """
    out_sum, in_sum = (stored(edges.groupBy(F.col(c).alias("host")).agg(F.sum("links").alias("links"), F.count("*").alias("n")), "host-degrees") for c in ("src", "dst"))
    total = lambda of, name: of.select(F.col("host").alias(name), F.col("links").alias(f"{name}_links"), "n")
    src_counts, dst_counts = class_counts(out_sum), class_counts(in_sum)
    shares = join_classes(edges, total(out_sum, "src"), "src", counts=src_counts)
    edges = stored(join_classes(shares, total(in_sum, "dst"), "dst", counts=dst_counts).select("src", "dst", (F.col("links") / F.col("src_links")).alias("forward"), (F.col("links") / F.col("dst_links")).alias("back")), "host-edges")
    hosts = out_sum.select("host").union(in_sum.select("host")).union(seeds.select("host")).distinct()
    kinds = ("trust", "distrust", "neutral")
    degree = lambda of, name: of.select("host", F.col("n").alias(name))
    start = hosts.join(seeds, "host", "left").join(degree(out_sum, "n_out"), "host", "left").join(degree(in_sum, "n_in"), "host", "left")
    start = stored(start.select("host", *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * (1 - damping)).alias(c) for c in kinds], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_out", "n_in")]), "host-seeds")
    mass = start.agg(F.sum(F.col("trust") + F.col("distrust") + F.col("neutral"))).first()[0] or 0.0
    rank = start
    if edges.isEmpty():
        return rank.select("host", *kinds)
    none = F.lit(0.0)
    for _ in range(rounds):
        along = join_classes(edges, rank.select(F.col("host").alias("src"), "trust", "neutral", F.col("n_out").alias("n")), "src", counts=src_counts).select(F.col("dst").alias("host"), (F.col("trust") * F.col("forward")).alias("trust"), none.alias("distrust"), (F.col("neutral") * F.col("forward")).alias("neutral"))
        against = join_classes(edges, rank.select(F.col("host").alias("dst"), "distrust", F.col("n_in").alias("n")), "dst", counts=dst_counts).select(F.col("src").alias("host"), none.alias("trust"), (F.col("distrust") * F.col("back")).alias("distrust"), none.alias("neutral"))
        came = along.union(against).groupBy("host").agg(*[(damping * F.sum(c)).alias(f"in_{c}") for c in kinds])
        new = start.join(came, "host", "left").join(rank.select("host", *[F.col(c).alias(f"old_{c}") for c in kinds]), "host")
        new = new.select("host", *[(F.col(c) + F.coalesce(f"in_{c}", none)).alias(c) for c in kinds], *[f"old_{c}" for c in kinds], "n_out", "n_in")
        rank = stored(new, "host-rank", instead=None if rank is start else rank)
        moved = rank.agg(sum((F.sum(F.abs(F.col(c) - F.col(f"old_{c}"))) for c in kinds), none)).first()[0] or 0.0
        if moved <= tolerance * mass:
            break
    return rank.select("host", *kinds)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url", html: str = "html", share: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    host, path = url_host(F.col(url)), url_path(F.col(url))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    seeds = judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("trust"), F.count_if(F.col("ruled") == "block").alias("distrust"), F.count_if(F.col("ruled").isNull()).alias("neutral"))
    rank = propagate(seeds, host_edges(pages, url, html))
    blocked = rank.where(F.col("distrust") > share * (F.col("trust") + F.col("distrust") + F.col("neutral"))).select("host", F.lit("block").alias("by_host"))
    # how many pages a host has is how many rows look it up; pages without a host have no verdict of their own
    verdicts = stored(seeds.select("host", F.expr("trust + distrust + neutral").alias("n")).join(blocked, "host", "left"), "host-verdicts")
    out = join_classes(judged, verdicts, "host", "left", sparse="by_host")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_host", F.lit("allow")).alias("verdict"))
