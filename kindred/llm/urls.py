"""Operator 4: URL filters, by rules and by trust that spreads over links between hosts. DataFrame functions only.

Rules name a host and a path; a rule covers its host and all subdomains where the url's path starts with its own, and
the longest wins. Where no rule decides, the host does. Hosts are seeds to the share of their pages that rules allow or
block. Trust is personalised PageRank from the allowed seeds along host edges; distrust is the same from the blocked
seeds against the edges, as who links to blocked hosts earns it. A host is blocked where its distrust exceeds its trust
by more than half of what a wholly blocked host has of itself. Rounds go on until all that is left to spread is less than
a tolerance for any host, however long the walks.

Edges are counted by (host, target) before anything is joined, and host tables are joined by host under adaptive
execution, which splits a hot one; neither hosts nor edges reach the driver.

Cases: a null url, or one without ``://``, has an empty host and path, takes no part in the graph and is allowed. Null or
empty html has no links; a relative link is one to the page's own host and adds no edge. Repeated pages count as often as
they occur. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import drop, materialize

#: The tolerance bounds what trust and distrust of a host still lack. ROUNDS is what the SQL beside this unrolls.
DAMPING, TOLERANCE, ROUNDS = 0.85, 1e-9, 10
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A link that names a host begins with a scheme or with ``//``; any other is relative, whatever stands further on.
ABSOLUTE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
LINK = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def ruled(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null where none does. ``rules``: (verdict, host/path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    # The last condition is tried first, so the longest rule comes last.
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links from a host's pages to another host, counted."""
    links = pages.select(host(pages[url_col]).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(pages[html_col], F.lit(LINK), F.lit(1)))).alias("link"))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return links.filter(F.col("link").rlike(ABSOLUTE)).select("src", host(absolute).alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust), converged; or after ``rounds`` rounds. ``seeds``: (host, t0, b0); ``links``: (src, dst, n)."""
    ends = links.select(F.col("src").alias("host")).union(links.select(F.col("dst").alias("host"))).distinct()
    base = ends.join(seeds, "host", "full").select("host", (F.lit(1 - damping) * F.coalesce("t0", F.lit(0.0))).alias("t"), (F.lit(1 - damping) * F.coalesce("b0", F.lit(0.0))).alias("b"))
    if links.isEmpty():
        return base.withColumnsRenamed({"t": "trust", "b": "distrust"})
    # Beside each sum what the last round added to it, as only that is passed on.
    rank = materialize(base.select("host", "t", "b", F.col("t").alias("dt"), F.col("b").alias("db")))
    out = links.groupBy("src").agg(F.sum("n").alias("out"))
    into = links.groupBy("dst").agg(F.sum("n").alias("in"))
    weighed = materialize(links.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("fw"), (F.col("n") / F.col("in")).alias("bw")))
    k, written = 0, rank
    while rounds is None or k < rounds:
        ahead = weighed.join(rank.filter("dt > 0").select(F.col("host").alias("src"), "dt"), "src").select(F.col("dst").alias("host"), (F.col("dt") * F.col("fw")).alias("t"), F.lit(0.0).alias("b"))
        back = weighed.join(rank.filter("db > 0").select(F.col("host").alias("dst"), "db"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("db") * F.col("bw")).alias("b"))
        got = ahead.union(back).groupBy("host").agg((F.lit(damping) * F.sum("t")).alias("ti"), (F.lit(damping) * F.sum("b")).alias("bi"))
        new_t, new_b = F.coalesce("ti", F.lit(0.0)), F.coalesce("bi", F.lit(0.0))
        rank = rank.join(got, "host", "left").select("host", (F.col("t") + new_t).alias("t"), (F.col("b") + new_b).alias("b"), new_t.alias("dt"), new_b.alias("db"))
        k += 1
        if k % 2 == 0:
            rank, old = materialize(rank), written
            drop(old)
            written = rank
            # A round passes on at most ``damping`` of what the last one did, so all later rounds together add no more
            # than this to any host.
            last = rank.agg(F.greatest(F.sum("dt"), F.sum("db"))).first()[0]
            if rounds is None and last * damping <= tolerance * (1 - damping):
                break
    return rank.select("host", F.col("t").alias("trust"), F.col("b").alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], damping: float = DAMPING, rounds: int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    placed = pages.select(pages[id_col].alias("page_id"), host(pages[url_col]).alias("host"), path(pages[url_col]).alias("path"))
    decided = placed.withColumn("r", ruled(rules, F.col("host"), F.col("path")))
    share = lambda v: F.count_if(F.col("r.verdict") == v) / F.count("*")
    seeds = decided.filter("host <> ''").groupBy("host").agg(share("allow").alias("t0"), share("block").alias("b0"))
    ranks = propagate(seeds, materialize(edges(pages, url_col, html_col)), damping, rounds)
    blocked = ranks.filter(F.col("distrust") - F.col("trust") > F.lit((1 - damping) / 2)).select("host", F.lit(True).alias("blocked"))
    return decided.join(blocked, "host", "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
