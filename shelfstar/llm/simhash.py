"""SimHash near-duplicates: fingerprints of word shingles, linked where few bits differ.

Pigeonhole blocks: the 64 bits are split into ``blocks`` blocks; of two fingerprints that differ in at most d
bits, all but d blocks agree, so the pair meets under the key of some choice of blocks - d blocks. The more
distinct fingerprints, the more blocks and the longer the keys, so buckets stay small. Links are exact.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfstar.llm.common import components, cut, fresh

SEED, BITS = 42, 64
#: Largest bucket whose members are compared in one task; larger ones are linked through common neighbours.
IN_TASK = 16384
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(data: bytes, k: int) -> list[int]:
    """XXH64 of every k-word shingle of a text, repeats included; the whole sequence if it is shorter."""
    words = data.translate(_LOWER).split()
    joined = b" ".join(words)
    if not words:
        return []
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    starts = np.r_[0, ends[:-1] + 1]
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())]


def fingerprint(hashes: list[int]) -> int:
    """Bits that are set in over half of the hashes; 0 for none."""
    if not hashes:
        return 0
    lanes = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(lanes), 1 << 16):
        bits = np.unpackbits(lanes[at:at + (1 << 16)], axis=1, bitorder="little")
        cuts = np.arange(0, len(bits), 255)  # sums of up to 255 bits fit into a byte
        ones += np.add.reduceat(bits, cuts, axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(lanes), bitorder="little").tobytes(), "little")


def fingerprints(text: Column, k: int) -> Column:
    @F.arrow_udf("bigint")
    def run(col: pa.Array) -> pa.Array:
        found = [fingerprint(shingle_hashes(x.as_py() or b"", k)) for x in col]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return run(text.cast("binary"))


def blocks_for(n: int, d: int) -> int:
    """The number of blocks for n distinct fingerprints: keys with some bits more than n has."""
    blocks = d + 1
    while blocks < d + 4 and BITS * (blocks - d) // blocks < np.log2(max(n, 2)) + 1:
        blocks += 1
    return blocks


def _masks(blocks: int, d: int) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    whole = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(whole, blocks - d)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _stars(d: int):
    def run(batches):
        """Links of a bucket as stars: every member to the smallest of its component within the bucket."""
        for batch in batches:
            a, b = [], []
            for members in batch.column(0):
                fps = np.sort(members.values.to_numpy(zero_copy_only=False))
                root = np.arange(len(fps))
                todo, seen = [], np.zeros(len(fps), bool)
                for i in range(len(fps)):
                    if seen[i]:
                        continue
                    seen[i], todo = True, [i]
                    while todo:
                        x = todo.pop()
                        near = np.flatnonzero(~seen & (np.bitwise_count((fps ^ fps[x]).view(np.uint64)) <= d))
                        seen[near], root[near] = True, i
                        todo += near.tolist()
                linked = root != np.arange(len(fps))
                a.append(fps[linked])
                b.append(fps[root[linked]])
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

    return run


def _neighbours(mask: Column, d: int) -> Column:
    """All values that differ from ``fp`` in at most d / 2 of the bits of ``mask``: two members with d differing bits share one."""
    bits = [F.lit(_signed(1 << i)) for i in range(BITS)]
    free = F.filter(F.array(*bits), lambda b: b.bitwiseAND(mask) != 0)
    out = F.array(F.lit(0).cast("long"))
    for _ in range((d + 1) // 2):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda v: F.transform(free, lambda b: v.bitwiseXOR(b))))))
    return F.transform(out, lambda v: F.col("fp").bitwiseXOR(v))


def links(fps: DataFrame, d: int, in_task: int = IN_TASK, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all pairs with at most d differing bits would.

    ``fps`` has one row per distinct ``fp``. A bucket gives stars, never all of its pairs.
    """
    masks = _masks(blocks or blocks_for(fps.count(), d), d)
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)])
    dealt = (fps.select("fp", F.explode(keys).alias("k"))
             .select("fp", "k.choice", "k.mask", F.col("fp").bitwiseAND(F.col("k.mask")).alias("key")))
    size = (dealt.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
            .withColumnRenamed("choice", "c").withColumnRenamed("key", "k"))
    met = cut(dealt.join(size, (F.col("choice") == F.col("c")) & (F.col("key") == F.col("k"))).drop("c", "k"), "buckets")
    small = met.where(F.col("n") <= in_task).groupBy("choice", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    stars = small.mapInArrow(_stars(d), "a long, b long")
    # A larger bucket: members meet at common neighbours within its free bits, where few members can meet.
    near = (met.where(F.col("n") > in_task).select("fp", "choice", F.explode(_neighbours(F.bitwise_not("mask"), d)).alias("at"))
            .groupBy("choice", "at").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1))
    pair = near.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b")
    return stars.union(pair).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, d: int = 4, in_task: int = IN_TASK) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``d`` differing bits between
    fingerprints of ``k``-word shingles. Null and empty texts have fingerprint 0, which links like any other.
    Rows without a doc_id are linked too but never name a component (null if nothing else is in it).
    Equal fingerprints are one node, so any number of copies costs one row; ties and repeated rows stay.
    """
    own = cut(docs.select("doc_id", fingerprints(F.col("text"), k).alias("fp")), "fingerprints")
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    return labelled(own, nodes, links(nodes.select("fp"), d, in_task))


def labelled(own: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``own`` (doc_id, fp) with component_id, from ``nodes`` (fp, least: smallest doc_id) and ``edges`` (a, b) between them."""
    roots = components(edges).withColumnRenamed("node", "f")
    rooted = nodes.join(roots, F.col("fp") == F.col("f"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    labels = rooted.join(named, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return own.join(labels, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, k: int = 5, d: int = 4) -> DataFrame:
    """One row of each component, the one with the smallest doc_id, with the columns of ``docs``.

    Rows that share that doc_id count as copies: one of them stays. A row without a doc_id goes if its
    component has a named one; of the others, one per fingerprint stays.
    """
    return first_of(docs, cut(near_duplicates(docs, k, d), "components"), fingerprints(F.col("text"), k))


def first_of(docs: DataFrame, found: DataFrame, mark: Column) -> DataFrame:
    """One row of each component of ``found`` (doc_id, fp, component_id); ``mark`` gives the fp of a row of ``docs``."""
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("first"))
    i, fp = fresh(docs, "i"), fresh(docs, "fp")
    plain = ids.where("n = 1 and first").select(F.col("doc_id").alias(i))
    out = docs.join(plain, F.col("doc_id") == F.col(i), "left_semi")
    shared = ids.where("n > 1 and first").select(F.col("doc_id").alias("c"))
    rest = (found.where("doc_id = component_id").join(shared, F.col("doc_id") == F.col("c")).groupBy("doc_id").agg(F.min("fp").alias("fp"))
            .union(found.where("doc_id is null and component_id is null").select("doc_id", "fp").distinct())
            .select(F.col("doc_id").alias(i), F.col("fp").alias("stays")))
    odd = docs.join(rest, F.col("doc_id").eqNullSafe(F.col(i)), "left_semi").withColumn(fp, mark)
    one = odd.join(rest, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(fp) == F.col("stays")), "left_semi").dropDuplicates(["doc_id", fp])
    return out.unionByName(one.drop(fp))
