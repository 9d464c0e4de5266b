"""URL filter: rules first, then trust and distrust spread over the graph of hosts.

A url's host runs from the first ``://`` to the next ``/``, ``?``, ``#`` or the end, with
A-Z in lower case; its path from there to ``?``, ``#`` or the end.  A rule names a host
and a path prefix, fits that host and all its subdomains, and the longest fitting rule
decides.

Other urls are judged by their host.  Links of all pages are counted per (source
host, linked host).  Hosts with pages that a rule allows are trusted seeds, hosts with
pages that a rule blocks are distrusted seeds, weighed by the number of such pages.
Trust is personalised PageRank from the trusted seeds along links; distrust is the
same walk from the distrusted seeds against the links (who links to a bad host is
suspect).  A walk that meets a host without links ends there.  A walk goes on until it
has reached every host it can reach, however far, and until no host passes on more than
``tolerance`` times the largest seed.  A host is blocked if its distrust exceeds ``ratio`` times
its trust; a host that neither walk reaches is allowed.

Scale: pages are read twice (links; verdicts).  Links shrink to
(host, host) counts by a partial aggregate, so a host with a third of all pages sends
one row per task.  Both walks share one table and one join per round; a round moves only
what the last one brought anew, and is written to the shared checkpoint folder.  Only the
table of judged hosts meets the pages again.  It is written first, so the planner knows its
size: below Spark's own threshold it is broadcast and pages are not shuffled, above it
they are joined by host with the skewed host split by AQE.

Edge cases: a null url, or one without ``://``, has an empty host and path, no rule fits
it and it is allowed; null html has no links; repeated pages count as often as they
occur; equal rules count once; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomcast.session import materialize, scalar

#: Relative margin by which distrust must exceed its threshold.
MARGIN = 1e-9
AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or without ``://``."""
    host = F.translate(
        F.regexp_extract(url, AFTER, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, AFTER, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, both null if none fits; rules are (verdict, host, path)."""
    longest_first = sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule_host, rule_path in reversed(longest_first):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links from pages of one host to another; links within a host do not count."""
    page = pages.select(
        split_url(F.col(url_col))[0].alias("src"),
        F.expr(f"regexp_extract_all(`{html_col}`, '(?i)href\\\\s*=\\\\s*[\"\\']?([^\"\\'\\\\s>]+)', 1)").alias("hrefs"),
    )
    # a relative link stays on its host; one that starts with // takes the page's scheme
    away = F.filter("hrefs", lambda h: h.startswith("//") | h.contains("://"))
    links = page.select("src", F.explode(away).alias("href"))
    target = F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), "href")).otherwise(F.col("href"))
    return (
        links.select("src", split_url(target)[0].alias("dst"))
        .filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def spread(seeds: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-9) -> DataFrame:
    """(host, trust, distrust) of every host that a walk reaches.

    ``seeds``: (host, allowed, blocked), page counts; ``links``: (src, dst, n).
    """
    walks = links.select(F.lit("trust").alias("walk"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").unionByName(
        links.select(F.lit("distrust").alias("walk"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    )
    out_links = walks.groupBy("walk", "host").agg(F.sum("n").alias("total"))
    steps = materialize(
        walks.join(out_links, ["walk", "host"]).select("walk", "host", "to", (damping * F.col("n") / F.col("total")).alias("p"))
    )
    weights = seeds.select(
        "host", F.explode(F.create_map(F.lit("trust"), "allowed", F.lit("distrust"), "blocked")).alias("walk", "w")
    ).filter("w > 0")
    # both walks start from pages, so a page allowed and a page blocked weigh the same; "moves" is what a host passes on next
    start = F.col("w") * (1 - damping)
    now = materialize(weights.select("walk", "host", start.alias("score"), start.alias("moves")))
    least = tolerance * (scalar(now.agg(F.max("score"))) or 0.0)
    while not now.filter("moves is not null").isEmpty():
        moved = now.filter("moves is not null").join(steps, ["walk", "host"])
        moved = moved.select("walk", F.col("to").alias("host"), (F.col("moves") * F.col("p")).alias("brought"))
        known = now.select("walk", "host", "score", F.lit(True).alias("known"))
        both = known.unionByName(moved, allowMissingColumns=True).groupBy("walk", "host")
        sums = both.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("score", "brought")), F.max("known").alias("known"))
        on = (F.col("brought") >= least) | (F.col("known").isNull() & (F.col("brought") > 0))
        now = materialize(
            sums.select("walk", "host", (F.col("score") + F.col("brought")).alias("score"), F.when(on, F.col("brought")).alias("moves"))
        )
    score = {w: F.coalesce(F.sum(F.when(F.col("walk") == w, F.col("score"))), F.lit(0.0)).alias(w) for w in ("trust", "distrust")}
    return now.groupBy("host").agg(*score.values())


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    ratio: float = 1.0,
    damping: float = 0.85,
    tolerance: float = 1e-9,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every page."""
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumn("rule", rule).withColumn("says", says)
    seeds = (
        ruled.filter("host != ''")
        .groupBy("host")
        .agg(F.count_if(F.col("says") == "allow").alias("allowed"), F.count_if(F.col("says") == "block").alias("blocked"))
    )
    scores = spread(seeds, host_links(pages, url_col, html_col), damping, tolerance)
    judged = materialize(scores.select(F.col("host").alias("of"), "trust", "distrust"))
    # the margin keeps the order in which sums are added from deciding between equals
    bad = F.coalesce(F.col("distrust") > (1 + MARGIN) * ratio * F.col("trust"), F.lit(False))
    return ruled.join(judged, F.col("host") == F.col("of"), "left").select(
        F.col(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("says", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
