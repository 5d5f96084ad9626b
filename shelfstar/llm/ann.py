"""Approximate nearest neighbours over learned partitions.

On a bounded sample, the neighbour graph is cut into balanced parts, and a softmax classifier learns to
predict the parts in which a vector's neighbours lie. Every vector is then put into its most probable part;
a query is routed to its most probable parts, and their members are ranked exactly.

Equal vectors are one member with its smallest ids, so copies add no work; large parts are searched in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfstar.llm.common import cut


@dataclass(frozen=True)
class Params:
    """``sample``: bound (expected) on the vectors that the model is fitted on, raised to ``per_part`` for each part;
    ``size``: aim for the members of a part, up to ``max_parts`` parts; ``recall``: a query is routed to as many parts
    as held-out rows of the sample (``held_out`` of them) need for this share of their neighbours;
    ``block_members`` and ``block_queries`` bound what one task compares at a time."""

    sample: int = 8192
    per_part: int = 32
    size: int = 1024
    max_parts: int = 1024
    recall: float = 0.96
    held_out: int = 1024
    neighbours: int = 10
    steps: int = 300
    block_members: int = 4096
    block_queries: int = 1024


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the k other rows of largest inner product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at:at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at:at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 0, slack: float = 1.05) -> np.ndarray:
    """Cut a graph into parts of almost equal size with few edges between them.

    Recursive bisection at the median of a vector smoothed over the edges, then passes of moves, best gains
    first, of nodes to the part that most of their neighbours are in, as far as there is room.
    """
    n, k = graph.shape
    rng = np.random.default_rng(seed)
    src, dst = np.r_[np.repeat(np.arange(n), k), graph.ravel()], np.r_[graph.ravel(), np.repeat(np.arange(n), k)]
    part = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    place = np.full(n, -1)
    while todo:
        nodes, first, many = todo.pop()
        part[nodes] = first
        if many == 1 or len(nodes) < 2:
            continue
        place[:] = -1
        place[nodes] = np.arange(len(nodes))
        inside = (place[src] >= 0) & (place[dst] >= 0)
        a, b = place[src[inside]], place[dst[inside]]
        degree = np.bincount(a, minlength=len(nodes)) + 1.0
        v = rng.standard_normal(len(nodes))
        for _ in range(30):
            v = (np.bincount(a, v[b], len(nodes)) + v) / degree
            v -= np.average(v, weights=degree)
            v /= np.abs(v).max() or 1.0
        half = many // 2
        order = np.argsort(v, kind="stable")
        at = round(len(nodes) * half / many)
        todo += [(nodes[order[:at]], first, half), (nodes[order[at:]], first + half, many - half)]
    room = int(np.ceil(slack * n / parts))
    for _ in range(12):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (src, part[dst]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < room:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, steps: int, use: np.ndarray) -> np.ndarray:
    """Softmax weights (dimensions + 1, parts) that predict the parts of a vector's neighbours and its own, from the rows ``use``."""
    n = len(x)
    goal = np.zeros((n, parts), np.float32)
    np.add.at(goal, (np.repeat(np.arange(n), graph.shape[1]), part[graph.ravel()]), 1.0)
    goal[np.arange(n), part] += max(1, graph.shape[1] // 2)
    goal /= goal.sum(axis=1, keepdims=True)
    scale = np.float32(4.0 / max(np.sqrt((x * x).sum(axis=1)).mean(), 1e-12))
    z = np.c_[x * scale, np.ones(n, np.float32)].astype(np.float32)
    w = np.zeros((z.shape[1], parts), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    rng = np.random.default_rng(1)
    for t in range(1, steps + 1):
        rows = use[rng.integers(0, len(use), min(len(use), 2048))]
        s = z[rows] @ w
        s = np.exp(s - s.max(axis=1, keepdims=True))
        g = z[rows].T @ (s / s.sum(axis=1, keepdims=True) - goal[rows]) / len(rows) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (1 - t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w[:-1] *= scale
    return w


def _matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(dtype, copy=False)


def _smallest_ids(keep: int):
    """Equal vectors of an Arrow batch as one row with their smallest ids."""
    def run(batches):
        for b in batches:
            df = b.to_pandas()
            df = df.sort_values("id").drop_duplicates(["k1", "k2", "id", "asks"]).groupby(["k1", "k2"], sort=False)
            first = df["vector"].first().reset_index()
            first["ids"] = df["id"].apply(lambda s: s.drop_duplicates().iloc[:keep].tolist()).to_numpy()
            first["asks"] = df["asks"].max().to_numpy()
            yield pa.RecordBatch.from_pandas(first, preserve_index=False)

    return run


def members(vectors: DataFrame, keep: int) -> DataFrame:
    """Distinct usable vectors (k1, k2, vector, ids, asks) of rows (id, vector, asks).

    ``ids`` are the ``keep`` smallest, ``asks`` tells whether any row asks. Unusable: null, empty, zero,
    with null or non-finite components, or of another length than most.
    """
    v = vectors.select("id", F.col("vector").cast("array<float>").alias("vector"), "asks").where("id is not null and vector is not null")
    sound = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0)
    v = v.where(sound)
    most = v.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    v = v.where(F.size("vector") == (most["d"] if most else 0)).withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64(F.lit("v"), "vector"))
    part = v.mapInArrow(_smallest_ids(keep), "k1 long, k2 long, vector array<float>, ids array<long>, asks boolean")
    least = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    for salt in (["s"], []):  # copies of one vector meet in two steps, with ``keep`` ids each
        part = part.withColumn("s", F.pmod(F.hash("ids"), F.lit(64))) if salt else part
        part = part.groupBy("k1", "k2", *salt).agg(F.any_value("vector").alias("vector"), least, F.max("asks").alias("asks"))
    return part.select("k1", "k2", "vector", "ids", "asks")


def _fit(found: DataFrame, n: int, p: Params) -> tuple[np.ndarray | None, int]:
    """The router and the number of parts to ask; no router if there is one part."""
    parts = int(np.clip(round(n / p.size), 1, p.max_parts))
    bound = max(p.sample, p.per_part * parts)
    rate = min(1.0, bound / max(n, 1))
    if parts == 1:
        return None, 1
    rows = found.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1).select("vector", "k1").toArrow()
    x = _matrix(rows.column("vector"), np.float32)[np.argsort(rows.column("k1").to_numpy(), kind="stable")]
    if len(x) < 4 * parts:
        return None, 1
    graph = neighbour_graph(x, p.neighbours)
    part = balanced_parts(graph, parts)
    held = np.arange(0, len(x), max(8, len(x) // p.held_out))
    w = fit_router(x, graph, part, parts, p.steps, np.setdiff1d(np.arange(len(x)), held))
    odds = _log_odds(x, w)
    order = np.argsort(np.argsort(-odds[held], axis=1, kind="stable"), axis=1)  # a part's place in a row's order
    places = np.take_along_axis(order, odds.argmax(axis=1)[graph[held]], axis=1)
    return w, int(np.quantile(places, p.recall, method="higher")) + 1


def _log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _assign(w: np.ndarray | None):
    def run(batches):
        for b in batches:
            x = _matrix(b.column("vector"), np.float32)
            part = _log_odds(x, w).argmax(axis=1) if w is not None else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32))], [*b.schema.names, "part"])

    return run


def _route(w: np.ndarray | None, held: np.ndarray, probes: int, enough: int):
    """The most probable parts that hold anything: ``probes`` of them, or more until they hold ``enough`` ids."""
    def run(batches):
        for b in batches:
            x = _matrix(b.column("vector"), np.float32)
            odds = _log_odds(x, w) if w is not None else np.zeros((len(x), 1), np.float32)
            odds[:, held == 0] = -np.inf
            order = np.argsort(-odds, axis=1, kind="stable")
            total = held[order].cumsum(axis=1)
            asked = np.minimum(np.maximum(probes, (total < enough).sum(axis=1) + 1), (held > 0).sum())
            rows = np.repeat(np.arange(len(x)), asked)
            part = np.concatenate([o[:a] for o, a in zip(order, asked)]).astype(np.int32) if len(x) else np.zeros(0, np.int32)
            t = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(part)], [*t.schema.names, "part"])

    return run


_FOUND = "k1 long, k2 long, hits array<struct<s:double,id:long>>"


def _search(keep: int):
    """One block of members against one block of queries: a row for each query with its ``keep`` best ids (s is the
    negative score), ties to smaller ids."""
    def run(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        q, m = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
        out: list[list] = [[], [], []]
        if len(q) and len(m):
            x, y = _matrix(q.column("vector")), _matrix(m.column("vector"))
            ids = m.column("ids").to_pylist()
            first = np.array([i[0] for i in ids])
            k1, k2 = q.column("k1").to_numpy(), q.column("k2").to_numpy()
            many = min(keep, len(y))
            for at in range(0, len(x), 256):
                rough = x[at:at + 256] @ y.T
                for i, row in enumerate(rough, at):
                    limit = np.partition(row, len(row) - many)[len(row) - many]
                    near = np.flatnonzero(row >= limit - 1e-9 * max(1.0, abs(limit)))
                    exact = (y[near] * x[i]).sum(axis=1)  # the same sum wherever the row lies in a block
                    order = np.lexsort((first[near], -exact))[:many]
                    best = sorted((-exact[o], j) for o in order for j in ids[near[o]])[:keep]
                    for column, value in zip(out, (k1[i], k2[i], [{"s": float(s), "id": j} for s, j in best])):
                        column.append(value)
        hit = pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())]))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("k1", "k2", "hits"), out, (pa.int64(), pa.int64(), hit))})

    return run


def nearest(vectors: DataFrame, k: int, p: Params | None = None) -> DataFrame:
    """(query_id, rank, id, score): for each row that asks its k nearest other rows found.

    ``vectors`` has id (long), vector (array of numbers) and asks (boolean); other columns are ignored. Score
    is the inner product in double precision; ties go to smaller ids. Rows without an id or with an unusable
    vector (see ``members``) take no part; rows that share an id count as one. With at most k other rows, all
    are returned. An empty table gives an empty result.
    """
    p = p or Params()
    keep = k + 1
    rows = vectors.select("id", "vector", F.coalesce("asks", F.lit(False)).alias("asks"))
    found = cut(members(rows, keep), "members")
    w, probes = _fit(found, found.count(), p)
    index = cut(found.mapInArrow(_assign(w), "k1 long, k2 long, vector array<float>, ids array<long>, asks boolean, part int"), "index")
    sizes = {r["part"]: (r["n"], r["held"]) for r in index.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("held")).collect()}
    held = np.zeros(w.shape[1] if w is not None else 1, np.int64)
    for part, (_, ids) in sizes.items():
        held[part] = ids
    routed = index.where("asks").drop("part").mapInArrow(_route(w, held, probes, keep), "k1 long, k2 long, vector array<float>, ids array<long>, asks boolean, part int")
    routed = cut(routed, "routed")
    asked = {r["part"]: r["n"] for r in routed.groupBy("part").agg(F.count("*").alias("n")).collect()}

    def blocks(counts: dict, size: int):  # a number per part, of which there are at most max_parts
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c in counts.items() for x in (int(c[0]), -(-int(c[1]) // size))]), F.col("part")), F.lit(1)) if counts else F.lit(1)

    own = {"m": blocks({a: b[0] for a, b in sizes.items()}, p.block_members), "q": blocks(asked, p.block_queries)}

    def deal(df: DataFrame, mine: str, other: str, asks: bool) -> DataFrame:
        return (df.withColumn("asks", F.lit(asks)).withColumn(mine, F.pmod(F.xxhash64("k1", "k2"), own[mine]).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), own[other] - 1)))
                .select("k1", "k2", "vector", "ids", "asks", "part", "m", "q"))

    grid = deal(index, "m", "q", False).unionByName(deal(routed, "q", "m", True))
    hits = grid.groupBy("part", "m", "q").applyInArrow(_search(keep), _FOUND)
    best = hits.groupBy("k1", "k2").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    best = best.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.slice(F.sort_array("hits"), 1, keep).alias("hits"))
    asking = rows.where("asks and id is not null and vector is not null").select(
        F.col("id").alias("query_id"), F.col("vector").cast("array<float>").alias("v")).select(
        "query_id", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("v"), "v").alias("k2")).distinct()
    each = asking.join(best, (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2")))
    own_out = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    return (each.select("query_id", F.posexplode(own_out).alias("at", "h"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("h.id").alias("id"), (-F.col("h.s")).alias("score")))
