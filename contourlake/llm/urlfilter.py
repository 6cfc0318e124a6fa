"""URL filter: host and path rules first, then trust and distrust carried along links between hosts.

Trusted mass starts at hosts in proportion to their pages that a rule allows and follows links (personalised PageRank);
distrust starts at hosts with blocked pages and follows links backward: who links to a blocked host is suspect.  Each
host gets one verdict from the two scores, which holds for its pages that no rule fits.  Everything is column
expressions, joins and aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (verdict, host, path); a rule fits the host and its subdomains where the path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
ITERATIONS = 200
TOLERANCE = 1e-7
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = None
    for verdict, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): pages of host src that link to another host dst.

    Links without a host of their own (relative ones, ``mailto:`` and the like) stay within the page's host and are
    dropped before rows are made, as are repeated links of one page; counts are combined before the shuffle.
    """
    link = F.regexp_extract_all(F.col(html_col), F.lit(HREF), F.lit(1))
    host = lambda u: host_of(F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("x:"), u)).otherwise(u))
    absolute = F.filter(link, lambda u: F.startswith(u, F.lit("//")) | u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"))
    rows = pages.filter(F.contains(F.col(html_col), F.lit("//"))).select(
        host_of(F.col(url_col)).alias("src"), F.array_distinct(F.transform(absolute, host)).alias("targets")
    )
    rows = rows.select("src", F.explode("targets").alias("dst")).filter("src <> '' and dst <> '' and src <> dst")
    return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(
    seeds: DataFrame, links: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float = TOLERANCE
) -> DataFrame:
    """(host, trust, distrust) from seeds (host, good, bad: non-negative weights) and links (src, dst, n).

    trust = (1 - damping) * seed + damping * (what links bring, and what hosts without links would lose, back to the
    seeds); distrust is the same over reversed links.  Each sums to 1 over all hosts if it has any seed, else it is 0.
    Ends when a round changes scores by less than ``tolerance`` in sum; the change shrinks by ``damping`` a round, so the
    default takes some 110 rounds at most, and a run that needs more than ``iterations`` is an error.  Each round is
    written to the shared folder.
    """
    ways = [
        links.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n"),
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n"),
    ]
    edges = ways[0].union(ways[1])
    out = edges.groupBy("kind", "a").agg(F.sum("n").alias("total"))
    edges = stored(
        edges.join(out, ["kind", "a"]).select("kind", F.col("a").alias("from"), F.col("b").alias("to"), (F.col("n") / F.col("total")).alias("share")),
        "host-edges",
    )
    weights = [
        seeds.select("host", F.lit("trust").alias("kind"), F.col("good").alias("w")),
        seeds.select("host", F.lit("distrust").alias("kind"), F.col("bad").alias("w")),
        edges.select(F.col("from").alias("host"), "kind", F.lit(0.0).alias("w")),
        edges.select(F.col("to").alias("host"), "kind", F.lit(0.0).alias("w")),
    ]
    nodes = weights[0].union(weights[1]).union(weights[2]).union(weights[3]).groupBy("host", "kind").agg(F.sum("w").alias("w"))
    whole = nodes.groupBy("kind").agg(F.sum("w").alias("whole"))
    linked = edges.select("kind", F.col("from").alias("host")).distinct().withColumn("open", F.lit(1))
    start = F.when(F.col("whole") > 0, F.col("w") / F.col("whole")).otherwise(0.0)
    base = nodes.join(F.broadcast(whole), "kind").join(linked, ["kind", "host"], "left")
    now = stored(
        base.select("kind", "host", start.alias("seed"), start.alias("score"), F.col("open").isNull().alias("ends"), F.lit(0.0).alias("change")), "trust"
    )
    for _ in range(iterations):
        flow = edges.join(now.select("kind", F.col("host").alias("from"), "score"), ["kind", "from"])
        flow = flow.groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("brought"))
        lost = now.groupBy("kind").agg(F.sum(F.when(F.col("ends"), F.col("score")).otherwise(0.0)).alias("lost"))
        new = (1 - damping) * F.col("seed") + damping * (F.coalesce("brought", F.lit(0.0)) + F.col("lost") * F.col("seed"))
        moved = now.join(flow, ["kind", "host"], "left").join(F.broadcast(lost), "kind")
        now = stored(moved.select("kind", "host", "seed", new.alias("score"), "ends", F.abs(new - F.col("score")).alias("change")), "trust")
        if (now.agg(F.sum("change")).first()[0] or 0.0) < tolerance:
            break
    else:
        raise RuntimeError(f"propagation has not settled to {tolerance} in {iterations} rounds")
    pick = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    return now.groupBy("host").agg(pick("trust").alias("trust"), pick("distrust").alias("distrust"))


def host_verdict(threshold: float = 0.5) -> Column:
    """block where distrust is over ``threshold`` of the host's trust and distrust together, else allow."""
    both = F.col("trust") + F.col("distrust")
    return F.when((both > 0) & (F.col("distrust") > threshold * both), "block").otherwise("allow")


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    threshold: float = 0.5,
    **options,
) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, trust, distrust.

    A null url, or one without ``://``, has empty host and path: no rule fits, and with no scores it is allowed.  A null
    html has no links.  Repeated rows give one row each; other columns are ignored; an empty table gives no rows.  Seeds
    are the shares of a host's pages that rules allow or block, so a host counts once however many pages it has; the
    broadcast tables hold two rows.  A hot host is pre-aggregated here and its join can be split.
    """
    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = parsed.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.when(F.col("_rule.verdict") == v, 1.0).otherwise(0.0))
    seeds = ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    scores = propagate(seeds, host_links(pages, url_col, html_col), **options).withColumn("_method", host_verdict(threshold))
    return ruled.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", "_method", F.lit("allow")).alias("verdict"),
        "trust",
        "distrust",
    )
