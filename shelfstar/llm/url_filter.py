"""URL filter: rules for hosts and paths, and trust spread over links for everything that no rule decides.

Pages that rules allow make their hosts seeds of trust, pages that rules block make theirs seeds of
distrust. Trust follows links (personalised PageRank), distrust goes against them, from those who are linked
to those who link. A host whose share of distrust passes a threshold is blocked. DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfstar.llm.common import cut
from shelfstar.sources.tables import reliable_checkpoint

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_URL = r"://([^/?#]*)([^?#]*)"
_LINK = r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule that fits: its host or a subdomain, and a path that starts with the rule's.

    Rules are a parameter of moderate length, tried from the longest (ties by name); null if none fits.
    """
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): absolute links between different hosts, counted."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))).alias("d"))
    found = found.select("src", F.translate("d", _UPPER, _UPPER.lower()).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return found.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int | None = None, damping: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """(host, trust, distrust) from seeds (host, s_trust, s_distrust; each sums to 1) over edges (src, dst, weight).

    Each round is one join and one sum: an edge carries trust from src to dst, by its share of what src links
    to, and distrust from dst to src, by its share of what links to dst. Hosts without links keep what they
    have; a round starts from a reliable checkpoint. Rounds go on until no host is newly reached and no value changes by more
    than ``tolerance`` of itself, which damping brings about (or for exactly ``rounds``, if given). Repeated edges add up; an
    empty table of edges leaves the seeds.
    """
    edges = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    leaving = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    coming = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    none = F.lit(0.0)
    ways = cut(edges.join(leaving, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("weight") / F.col("total")).alias("wt"), none.alias("wd"))
               .union(edges.join(coming, "dst").select("dst", "src", none, F.col("weight") / F.col("total"))), "ways")
    hosts = seeds.select("host").union(ways.select("a")).distinct()
    start = cut(hosts.join(seeds, "host", "left").select("host", *[F.coalesce(c, none).alias(c) for c in ("s_trust", "s_distrust")]), "hosts")
    now = start.select("host", ((1 - damping) * F.col("s_trust")).alias("trust"), ((1 - damping) * F.col("s_distrust")).alias("distrust"))
    if ways.isEmpty():
        return now
    moved = F.lit(False)
    for c in ("trust", "distrust"):  # a value of 0 that becomes positive is a host newly reached
        moved = moved | (F.abs(F.col(c) - F.col(f"old_{c}")) > tolerance * F.col(c))
    for done in count(1):
        sent = (ways.join(now, F.col("a") == F.col("host")).groupBy(F.col("b").alias("h"))
                .agg(F.sum(F.col("wt") * F.col("trust")).alias("t"), F.sum(F.col("wd") * F.col("distrust")).alias("d")))
        old = now.select(F.col("host").alias("old"), F.col("trust").alias("old_trust"), F.col("distrust").alias("old_distrust"))
        both = reliable_checkpoint(start.join(sent, F.col("host") == F.col("h"), "left").join(old, F.col("host") == F.col("old")).select(
            "host", ((1 - damping) * F.col("s_trust") + damping * F.coalesce("t", none)).alias("trust"),
            ((1 - damping) * F.col("s_distrust") + damping * F.coalesce("d", none)).alias("distrust"), "old_trust", "old_distrust"))
        now = both.select("host", "trust", "distrust")
        if done == rounds or (rounds is None and both.where(moved).isEmpty()):
            return now


def judge(pages: DataFrame, rules: list[Rule], extra_edges: DataFrame | None = None, rounds: int | None = None, damping: float = 0.85,
          threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages`` (page_id, url, html).

    verdict is that of the longest rule that fits, else block if the host's distrust is more than
    ``threshold`` of its trust and distrust together, else allow; pages without a host are allowed. Null and
    odd urls have an empty host and path; a null html has no links; repeated rows are judged alike and each
    counts for its host. Other columns are ignored; an empty table gives an empty result.
    """
    ruled = {r.name: r.verdict for r in rules}
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = cut(seen.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)), "judged")
    by_rule = F.try_element_at(F.create_map(*[F.lit(x) for kv in ruled.items() for x in kv]), F.col("rule")) if ruled else F.lit(None).cast("string")
    counts = seen.where("host <> ''").groupBy("host").agg(F.count(F.when(by_rule == "allow", 1)).cast("double").alias("good"),
                                                          F.count(F.when(by_rule == "block", 1)).cast("double").alias("bad"))
    counts = cut(counts, "seeds")
    good, bad = counts.agg(F.sum("good"), F.sum("bad")).first()
    seeds = counts.select("host", (F.col("good") / F.lit(good or 1.0)).alias("s_trust"), (F.col("bad") / F.lit(bad or 1.0)).alias("s_distrust"))
    edges = link_edges(pages)
    edges = edges.unionByName(extra_edges.select("src", "dst", "weight")) if extra_edges is not None else edges
    spread = propagate(seeds, edges, rounds, damping).withColumnRenamed("host", "h")
    share = F.col("distrust") > F.lit(threshold) * (F.col("trust") + F.col("distrust"))
    return (seen.join(spread, F.col("host") == F.col("h"), "left")
            .select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.when(share, "block").otherwise("allow")).alias("verdict"), "trust", "distrust"))
