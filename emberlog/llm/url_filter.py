"""URL verdicts: rules first, then trust and distrust that spread over the links between hosts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.storage import stage

LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
DAMPING, TOLERANCE = 0.85, 1e-6
#: Rounds in one plan; after them the scores are written down and compared.
ROUNDS_A_STAGE = 5
#: A host without a rule's verdict is blocked if its distrust is over this many times its trust.
LEAST_DISTRUST = 1.0


def rounds_needed(damping: float, tolerance: float) -> int:
    """Round k moves no more than 2 * damping^k of the mass: what it takes away and what it puts elsewhere."""
    return max(1, math.ceil(math.log(tolerance / 2) / math.log(damping)))


ROUNDS = rounds_needed(DAMPING, TOLERANCE)


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` (allow or block) for a host with all its subdomains and all paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"), UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/ ? #``, A-Z lower-cased, and from there up to ``?`` or ``#``.

    Both are empty for null and for what has no ``://``.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules: Sequence[UrlRule] = RULES) -> DataFrame:
    """``page_id, host, path, rule, ruled``: the longest rule that fits (the first listed of equals) and its verdict."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule = verdict = F.when(F.lit(False), F.lit(None).cast("string"))
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = rule.when(fits, F.lit(r.name)), verdict.when(fits, F.lit(r.verdict))
    return rows.select("*", rule.alias("rule"), verdict.alias("ruled"))


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links from each page's host to other hosts. A relative link stays on its host and is none."""
    host, _ = host_and_path(F.col("url").cast("string"))
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.col("html").cast("string"), F.lit(LINK), F.lit(1))).alias("to"))
    return links.select("src", lower_ascii(F.col("to")).alias("dst")).filter("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, trust, distrust`` by personalised PageRank from ``seeds(host, trusted, blocked)``, masses of evidence.

    Trust flows along ``links(src, dst, n)`` in proportion to ``n``, distrust against them: who links to a blocked host
    is suspect, who is linked to by a trusted one is not. Hosts without links on lose what flows from them. Rounds go
    on until no more than ``tolerance`` of the mass moves; :func:`rounds_needed` bounds them, and fewer ``rounds`` that
    don't get there are an error. Both flows run in one plan; each round is one join and one
    aggregate with sums combined before the shuffle, and hubs' joins can be split. No links: seeds keep what they have,
    less the damping. Links that repeat add up; null hosts are hosts that nothing else links to; no seeds give no rows.
    """
    both = links.select(F.lit(0).alias("kind"), F.col("src").alias("node"), F.col("dst").alias("to"), "n").union(links.select(F.lit(1), "dst", "src", "n"))
    out = both.groupBy("kind", "node").agg(F.sum("n").alias("all"))
    edges = stage(both.join(out, ["kind", "node"]).select("kind", "node", "to", (F.col("n") / F.col("all")).alias("part")), "host-edges")
    seeded = stage(seeds.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trusted").cast("double").alias("mass")), F.struct(F.lit(1).alias("kind"), F.col("blocked").cast("double").alias("mass")))).alias("s"), "host").select("s.kind", F.col("host").alias("node"), "s.mass").filter("mass > 0"), "host-seeds")
    base = seeded.select("kind", "node", ((1 - damping) * F.col("mass")).alias("mass"))
    total = seeded.agg(F.sum("mass")).first()[0] or 0.0
    scores, done, rounds = seeded, 0, rounds_needed(damping, tolerance) if rounds is None else rounds
    if edges.isEmpty():  # nothing moves
        scores, rounds = base, 0
    while done < rounds:
        for _ in range(min(ROUNDS_A_STAGE, rounds - done)):
            moved = scores.join(edges, ["kind", "node"]).select("kind", F.col("to").alias("node"), (damping * F.col("mass") * F.col("part")).alias("mass"))
            scores, last = base.union(moved).groupBy("kind", "node").agg(F.sum("mass").alias("mass")), scores
        done += min(ROUNDS_A_STAGE, rounds - done)
        change = scores.union(last.select("kind", "node", -F.col("mass"))).groupBy("kind", "node").agg(F.sum("mass").alias("mass"))
        # The last two rounds are written together: the scores, and how far each has moved.
        scores = stage(scores.withColumn("moved", F.lit(0.0)).union(change.select("kind", "node", F.lit(0.0), F.abs("mass"))).groupBy("kind", "node").agg(F.sum("mass").alias("mass"), F.sum("moved").alias("moved")), "host-scores")
        if (scores.agg(F.sum("moved")).first()[0] or 0.0) <= tolerance * total:
            break
        scores = scores.drop("moved")
    else:
        if rounds:
            raise RuntimeError(f"scores still move after {done} rounds")
    return scores.groupBy(F.col("node").alias("host")).agg(*(F.round(F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0)), 9).alias(n) for k, n in enumerate(("trust", "distrust"))))


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule] = RULES, links: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row of ``pages(page_id, url, html)``.

    A rule's verdict stands. All others go by their host: the pages that rules allow and block are the seeds of
    :func:`spread` over ``links`` (those in ``html`` by default), and a host is blocked if its distrust is over
    LEAST_DISTRUST times its trust; without either it is allowed. Null urls have no host and are allowed. Rows that
    repeat are judged and counted each; no rows give none.
    """
    judged = with_rule(pages, rules)
    seeds = judged.filter("ruled IS NOT NULL AND host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("trusted"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    scores = spread(host_links(pages) if links is None else links, seeds)
    none = F.coalesce(F.col("distrust"), F.lit(0.0)) <= LEAST_DISTRUST * F.coalesce(F.col("trust"), F.lit(0.0))
    verdict = F.coalesce("ruled", F.when(none, "allow").otherwise("block"))
    return judged.join(scores, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")))
