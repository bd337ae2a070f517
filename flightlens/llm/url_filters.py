"""URL filters: rules on hosts and paths, and link-graph propagation for the rest.

Rules decide the URLs they fit. For the others, hosts are nodes of a graph whose edges are
the links of their pages to other hosts. Hosts of which most pages fit an allow rule are
trusted seeds, hosts of which most fit a block rule are blocked seeds, each with its pages
as weight. Trust is a personalised PageRank from the trusted seeds along the links;
distrust is one from the blocked seeds against the links (who links to a blocked host is
suspect). A host whose distrust is larger than ``margin`` times its trust, and at least
``least`` times an even share, is blocked.

Pages are reduced to host rows and host edges before the first iteration. Each iteration is
one join and one aggregate over the edges; its ranks are written to the shared folder,
which cuts the lineage and lets the adaptive plan split the edges of a very large host. A
host without links to others keeps its rank. Iterations end when all that can still move,
summed over the hosts, is under ``TOLERANCE`` of the smallest rank that can block a host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlens.llm.common import free_name, lower_ascii, quoted
from flightlens.session import materialize

LINKS = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""
DAMPING, TOLERANCE = 0.85, 0.01


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1)


def fits(host: Column, path: Column, rule: Rule) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def first_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; of equally long ones the first. Null if none fits."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(ordered):
        fit = fits(host, path, rule)
        text, verdict = F.when(fit, rule.text).otherwise(text), F.when(fit, rule.verdict).otherwise(verdict)
    return text, verdict


def pagerank(edges: DataFrame, hosts: DataFrame, *, iterations: int | None = None, damping: float, tolerance: float = 1e-9, name: str) -> DataFrame:
    """(host, rank): PageRank over ``edges`` (src, dst, w: share of src) that restarts at ``hosts.seed``.

    The shares of each host sum to 1, so the ranks do too; they are all 0 without seeds. A fixed
    number of ``iterations``, or as many as it takes until the ranks differ from the limit by at most
    ``tolerance`` in sum (not below 1e-12): a change shrinks by ``damping`` each time.
    """
    if iterations is None and not 0 <= damping < 1:
        raise ValueError("ranks settle only with a damping from 0 to below 1")
    total = hosts.agg(F.sum("seed").alias("s")).first().s or 0.0
    ranks = hosts.select("host", (F.col("seed") / (total or 1.0)).alias("start")).withColumn("rank", F.col("start"))
    step = 0
    while total and step != iterations:
        moved = edges.join(ranks.select(F.col("host").alias("src"), "rank"), "src")
        moved = moved.groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        rank = F.coalesce("got", F.lit(0.0)) * damping + F.col("start") * (1 - damping)
        after = ranks.join(moved, "host", "left").select("host", "start", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("change"))
        ranks, step = materialize(after, f"{name}-{step}"), step + 1
        if iterations is None and (ranks.agg(F.sum("change").alias("s")).first().s or 0.0) * damping <= max(tolerance, 1e-12) * (1 - damping):
            break
    return ranks.select("host", "rank")


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.expr("array_distinct(links)")).alias("dst")).where("src != dst AND src != '' AND dst != ''")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_verdicts(pages: DataFrame, *, iterations: int | None = None, damping: float = DAMPING, margin: float = 1.0, least: float = 0.1) -> DataFrame:
    """(host, trust, distrust, blocked) from pages with host, links and verdict (null: no rule fits).

    ``iterations``: of the ranks; without it they are iterated until they settle.
    """
    own = pages.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("denied"))
    own = materialize(own.where("host != ''"), "hosts")
    edges = materialize(link_edges(pages), "links")
    named = own.select("host", "n", "allowed", "denied").unionByName(edges.select(F.col("dst").alias("host"), *(F.lit(0).cast("long").alias(c) for c in ("n", "allowed", "denied"))))
    hosts = materialize(named.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "allowed", "denied"))), "nodes")
    count = max(hosts.count(), 1)

    def shares(src: str, dst: str) -> DataFrame:
        """Outgoing shares; a host without links keeps its rank by a link to itself."""
        every = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "n")
        out = every.groupBy("src").agg(F.sum("n").alias("all"))
        alone = hosts.select(F.col("host").alias("src")).join(out, "src", "left_anti").select("src", F.col("src").alias("dst"), F.lit(1.0).alias("w"))
        return materialize(every.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("w")).unionByName(alone), f"shares-{src}")

    def seeds(column: str) -> DataFrame:
        return hosts.select("host", F.when(2 * F.col(column) > F.col("n"), F.col(column)).otherwise(0).cast("double").alias("seed"))

    settings = {"iterations": iterations, "damping": damping, "tolerance": TOLERANCE * least / count}
    trust = pagerank(shares("src", "dst"), seeds("allowed"), **settings, name="trust")
    distrust = pagerank(shares("dst", "src"), seeds("denied"), **settings, name="distrust")
    both = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host")
    return both.withColumn("blocked", (F.col("distrust") > margin * F.col("trust")) & (F.col("distrust") * count >= least))


def judge_urls(pages: DataFrame, *, rules=RULES, url: str = "url", html: str = "html", **settings) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block).

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: up to
    ``?``, ``#`` or the end. A URL that is null or has no ``://`` has neither, fits no rule and is
    allowed, as is one whose host has no seed near it. A null page has no links. Repeated rows
    count each time. An empty table gives an empty result. Columns of these names are replaced. A host with as much distrust as
    ``margin`` times its trust is allowed. A page is one value, whatever its length; its links are found in one pass.
    """
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*quoted(kept))
    h, p, r, v = (free_name(rows, x) for x in ("host_", "path_", "rule_", "verdict_"))
    seen = rows.withColumns({h: host_of(F.coalesce(F.col(url), F.lit(""))), p: path_of(F.coalesce(F.col(url), F.lit("")))})
    text, verdict = first_rule(F.col(h), F.col(p), rules)
    seen = seen.withColumns({r: text, v: verdict})
    links = F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINKS), F.lit(1)), lower_ascii)
    graph = seen.select(F.col(h).alias("host"), F.col(v).alias("verdict"), links.alias("links"))
    found = host_verdicts(graph, **settings).where("blocked").select(F.col("host").alias(h), F.lit("block").alias("by_links"))
    found = materialize(found, "blocked-hosts")
    judged = seen.join(found, h, "left")
    return judged.select(*quoted(kept), F.col(h).alias("host"), F.col(p).alias("path"), F.col(r).alias("rule"), F.coalesce(F.col(v), F.col("by_links"), F.lit("allow")).alias("verdict"))
