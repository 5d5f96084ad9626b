"""Removal of passages that repeat, byte for byte, anywhere in a collection of documents.

Any two equal strings of ``length`` bytes share an anchor: the k-gram with the smallest hash among their
k-grams, at the same place in both. So the documents are cut into segments around anchors that occur more
than once, and all segments round one anchor form a collection whose strings are aligned. For each collection
the suffixes are sorted column by column, from right to left: every round puts one more symbol before each
segment, and the order of the suffixes (whose preceding symbols are a column of the collection's
Burrows-Wheeler transform) and their common prefixes follow from those of the round before by one stable
pass. Where a common prefix reaches ``length``, the string that starts there repeats. ``transform`` returns
the columns of the transform as rows; the removal reads them as they are made.

A collection holds bounded segments, so a round's columns fit in a task and no task writes files of its own;
what the tasks exchange goes through Spark. Anchors with more segments than a task should hold are resolved
by counting hashes of their windows, which any number of tasks can share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfstar.llm.common import cut, digest, fresh


@dataclass(frozen=True)
class Params:
    """``length``: bytes of a string that counts as repeated; ``k``: bytes of an anchor; ``in_task``: segments of
    one anchor that a task sorts; ``chunk``: segments that a task sorts together."""

    length: int = 200
    k: int = 32
    in_task: int = 65536
    chunk: int = 16384

    @property
    def side(self) -> int:
        return self.length - self.k

    @property
    def width(self) -> int:
        return 2 * self.length - self.k


_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)  # low bits that hold a place; so many bytes are hashed at a time
_PIECE = 1 << 22


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-gram: powers of two of bytes' random values, combined by doubling."""
    h, have = _mix(data.astype(np.uint64) + _BASE), 1
    out, at = None, 0
    while True:
        if k & have:  # the binary digits of k say which lengths to put together
            part = h[at:]
            out = part.copy() if out is None else out[:len(part)] * _BASE + part[:len(out)]
            at += have
        have *= 2
        if have > k:
            return out[:max(0, len(data) - k + 1)]
        h = h[:max(0, len(h) - have // 2)] * (_BASE + np.uint64(2 * have)) + h[have // 2:]


def anchors(data: bytes, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text: for every window of ``length`` bytes the first smallest k-gram."""
    n, w = len(data), p.side + 1
    if n < p.length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found, hashes = [], []
    for start in range(0, n - p.length + 1, _PIECE):
        raw = np.frombuffer(data, np.uint8, min(n - start, _PIECE + p.length - 1), start)
        h = _mix(gram_hashes(raw, p.k))
        m = len(h)
        tagged = (h & ~_LOW) | np.arange(m, dtype=np.uint64)
        padded = np.concatenate([tagged, np.full(-m % w, ~np.uint64(0))]).reshape(-1, w)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:m - w + 1], ahead[w - 1:m])
        at = np.unique((least & _LOW).astype(np.int64))
        found.append(at + start)
        hashes.append(h[at])
    at, first = np.unique(np.concatenate(found), return_index=True)
    return at, np.concatenate(hashes)[first]


def _emit_anchors(p: Params):
    def run(batches):
        """One row for each anchor of a text, with a mark if the text has it more than once."""
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                rows, hs, again = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for r, x in enumerate(some.column("text")):
                    h, n = np.unique(anchors(x.as_py(), p)[1], return_counts=True)
                    rows.append(np.full(len(h), r))
                    hs.append(h)
                    again.append(np.minimum(n, 2))
                rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), some.column("k1").take(rows), some.column("k2").take(rows),
                                                  pa.array(np.concatenate(again).astype(np.int64))], ["anchor", "k1", "k2", "n"])

    return run


_COVER = "k1 long, k2 long, start int, stop int"
_SEGMENTS = "k1 long, k2 long, anchor long, hot boolean, at int, lead int, part binary"


def _emit_segments(p: Params):
    """Segments (left side, anchor, right side) round the anchors asked for. Equal segments of a text are sent once,
    and such a text's own repeats are reported at once, as rows without an anchor: at and lead are start and stop."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                some = b.slice(lo, 64)
                out: list[list] = [[] for _ in range(6)]
                for r in range(some.num_rows):
                    data = some.column("text")[r].as_py()
                    asked = {x["anchor"]: x["hot"] for x in some.column("asked")[r].as_py()}
                    places: dict[tuple, list[int]] = {}
                    at, h = anchors(data, p)
                    want = np.isin(h, np.array(list(asked), np.int64).view(np.uint64))
                    for i, a in zip(at[want].tolist(), h[want].view(np.int64).tolist()):
                        lead = min(i, p.side)
                        places.setdefault((a, lead, data[i - lead:i + p.length]), []).append(i)
                    for (a, lead, part), where in places.items():
                        i = where[0]
                        for column, value in zip(out, (r, a, asked[a], i, lead, part)):
                            column.append(value)
                        if len(where) > 1 and len(part) >= p.length:
                            for i in where:
                                for column, value in zip(out, (r, None, False, i - lead, i - lead + len(part), None)):
                                    column.append(value)
                rows = pa.array(out[0], pa.int64())
                kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("k1").take(rows), some.column("k2").take(rows), *[pa.array(c, t) for c, t in zip(out[1:], kinds)]],
                                                 ["k1", "k2", "anchor", "hot", "at", "lead", "part"])

    return run


def columns(parts: list[bytes], lead: np.ndarray, group: np.ndarray, p: Params):
    """Insert one symbol per segment and round, from right to left; yields (column, order, symbols, common).

    ``order`` sorts the suffixes that start at the column, within each group of ``group`` (not decreasing, from
    0); ``symbols`` are those just inserted, in the order of the round before, i.e. a column of the transform;
    ``common`` is the length of the common prefix with the suffix before, 0 at the start of a group. Segments
    are aligned at their anchors; where one has no byte, it agrees with nothing.
    """
    m = len(parts)
    table = np.full((m, p.width), -1, np.int16)
    for i, (part, left) in enumerate(zip(parts, lead.tolist())):
        table[i, p.side - left:p.side - left + len(part)] = np.frombuffer(part, np.uint8)
    table = np.ascontiguousarray(table.T)
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    for c in range(p.width - 1, -1, -1):
        symbols = table[c, order]
        by = np.argsort(symbols.view(np.uint16), kind="stable")
        by = by[np.argsort(group[order[by]], kind="stable")]
        order, seen = order[by], symbols[by]
        same = np.flatnonzero((seen[1:] == seen[:-1]) & (seen[1:] >= 0) & (group[order[1:]] == group[order[:-1]])) + 1
        new = np.zeros(m + 1, np.int32)
        if len(same):  # equal symbols keep their order, so their suffixes agree as far as all between them
            span = np.empty(2 * len(same), np.int64)
            span[::2], span[1::2] = by[same - 1] + 1, by[same] + 1
            first = (np.arange(m) == 0) | (group[order] != group[np.roll(order, 1)])
            new[same] = 1 + np.where(first[same], 0, np.minimum.reduceat(common, span)[::2])
        common = new
        yield c, order, symbols, common[:m]


def _repeats(parts: list[bytes], lead: np.ndarray, group: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """First and last column at which a segment's string of ``length`` bytes repeats in its group; (width, -1) for none."""
    low, high = np.full(len(parts), p.width), np.full(len(parts), -1)
    for c, order, _, common in columns(parts, lead, group, p):
        if c <= p.side:
            hit = common >= p.length
            rows = np.union1d(order[hit], order[np.flatnonzero(hit) - 1]) if hit.any() else []
            low[rows] = np.minimum(low[rows], c)
            high[rows] = np.maximum(high[rows], c)
    return low, high


def _chunks(batches, p: Params):
    """Rows sorted by anchor, in tables that end where an anchor ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= p.chunk:
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("anchor").to_numpy()
            end = int(np.searchsorted(key, key[-1]))
            if end:
                yield t.slice(0, end)
                held = t.slice(end).to_batches()
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield t


def _sorted_anchors(t: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    key = t.column("anchor").to_numpy()
    group = np.r_[0, (np.diff(key) != 0).cumsum()]
    return t.column("part").to_pylist(), t.column("lead").to_numpy(), group.astype(np.uint16 if group[-1] < 65536 else np.int64)


def _cover(p: Params):
    def run(batches):
        for t in _chunks(batches, p):
            parts, lead, group = _sorted_anchors(t)
            low, high = _repeats(parts, lead, group, p)
            hit = np.flatnonzero(high >= 0)
            start = t.column("at").to_numpy()[hit] - p.side
            yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(pa.array(hit)) for c in ("k1", "k2")]
                                             + [pa.array((start + x[hit] + y).astype(np.int32)) for x, y in ((low, 0), (high, p.length))], ["k1", "k2", "start", "stop"])

    return run


def _transform(p: Params):
    def run(batches):
        for t in _chunks(batches, p):
            parts, lead, group = _sorted_anchors(t)
            ends = np.r_[np.flatnonzero(np.diff(group)) + 1, len(group)]
            key = t.column("anchor").to_numpy()
            for c, _, symbols, common in columns(parts, lead, group, p):
                cuts = list(zip(np.r_[0, ends[:-1]], ends))
                yield pa.RecordBatch.from_arrays([pa.array([key[a] for a, _ in cuts]), pa.array([c] * len(cuts), pa.int32()),
                                                  pa.array([symbols[a:b].tolist() for a, b in cuts], pa.list_(pa.int16())),
                                                  pa.array([common[a:b].tolist() for a, b in cuts], pa.list_(pa.int32()))], ["anchor", "column", "symbols", "common"])

    return run


def _windows(p: Params):
    """A hash of every window of a segment, for anchors with too many segments for a task."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                some = b.slice(lo, 128)
                rows, start, h1, h2 = [], [], [], []
                for r in range(some.num_rows):
                    part, first = some.column("part")[r].as_py(), some.column("at")[r].as_py() - some.column("lead")[r].as_py()
                    for o in range(len(part) - p.length + 1):
                        h = xxhash.xxh3_128_intdigest(part[o:o + p.length])
                        rows.append(r)
                        start.append(first + o)
                        h1.append((h >> 64) - (1 << 63))
                        h2.append((h & (1 << 64) - 1) - (1 << 63))
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("k1").take(rows), some.column("k2").take(rows), pa.array(start, pa.int32()),
                                                  pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["k1", "k2", "start", "h1", "h2"])

    return run


def _segments(texts: DataFrame, p: Params) -> DataFrame:
    """Segments round the anchors that occur more than once in the distinct texts (k1, k2, text: binary)."""
    long = texts.where(F.octet_length("text") >= p.length).select("k1", "k2", "text")
    found = cut(long.mapInArrow(_emit_anchors(p), "anchor long, k1 long, k2 long, n long"), "anchors")
    often = found.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("anchor").alias("a"), (F.col("n") > p.in_task).alias("hot"))
    asked = (found.join(often, F.col("anchor") == F.col("a")).groupBy(F.col("k1").alias("x1"), F.col("k2").alias("x2"))
             .agg(F.collect_set(F.struct("anchor", "hot")).alias("asked")))
    one = long.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    return one.join(asked, (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2"))).select("k1", "k2", "text", "asked").mapInArrow(_emit_segments(p), _SEGMENTS)


def _by_anchor(segments: DataFrame) -> DataFrame:
    return segments.where("anchor is not null and not hot").repartition("anchor").sortWithinPartitions("anchor")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    k1, k2 = digest(t)
    return docs.select(k1.alias("k1"), k2.alias("k2"), t.cast("binary").alias("text"))


def transform(docs: DataFrame, p: Params | None = None, text: str = "text") -> DataFrame:
    """(anchor, column, symbols, common): the transform's columns and common prefixes of every collection.

    Rows of a column are in the order of the suffixes that start right of it (``symbols``) and at it
    (``common``). -1 stands for no byte.
    """
    p = p or Params()
    return _by_anchor(_segments(_keyed(docs, text), p)).mapInArrow(_transform(p), "anchor long, column int, symbols array<short>, common array<int>")


def spans(docs: DataFrame, p: Params | None = None, text: str = "text") -> DataFrame:
    """(k1, k2, n, spans): for each distinct text (by digest) the rows that have it and its maximal repeated runs.

    spans is null if nothing is known to repeat within or between texts; a text that several rows have repeats
    as a whole anyway, if it is long enough.
    """
    p = p or Params()
    keyed = _keyed(docs, text)
    segments = cut(_segments(keyed, p), "segments")
    own = segments.where("anchor is null").select("k1", "k2", F.col("at").alias("start"), F.col("lead").alias("stop"))
    sorted_ = _by_anchor(segments).mapInArrow(_cover(p), _COVER)
    windows = segments.where("hot").mapInArrow(_windows(p), "k1 long, k2 long, start int, h1 long, h2 long")
    place = F.struct("k1", "k2", "start")  # a window may be met at several of its anchors
    twice = windows.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select(F.col("h1").alias("x1"), F.col("h2").alias("x2"))
    hot = windows.join(twice, (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2"))).select("k1", "k2", "start", (F.col("start") + p.length).alias("stop"))
    merged = F.aggregate(
        F.array_sort("runs"), F.array().cast("array<struct<start:int,stop:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] >= x["start"]),
                              F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                                       F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"),
                                                        F.greatest(F.try_element_at(acc, F.lit(-1))["stop"], x["stop"]).alias("stop")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop"))))))
    runs = own.union(sorted_).union(hot).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))
    runs = runs.select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), merged.alias("spans"))
    copies = keyed.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    return copies.join(runs, (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2")), "left").select("k1", "k2", "n", "spans")


def remaining(data: Column, found: Column) -> Column:
    """The bytes of ``data`` outside the spans."""
    stops = F.concat(F.array(F.lit(0)), F.transform(found, lambda s: s["stop"]))
    starts = F.concat(F.transform(found, lambda s: s["start"]), F.array(F.octet_length(data)))
    parts = F.zip_with(stops, starts, lambda a, b: F.substring(data, a + 1, b - a))
    return F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x))


def mark(docs: DataFrame, p: Params | None = None, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a column of the spans (start, stop in bytes of the text) to remove; returns its name.

    Strings are judged on the input: every byte goes that lies in a string of ``length`` bytes that also starts
    elsewhere, in the same text or another row. Null texts are empty; texts shorter than ``length`` keep all.
    """
    p = p or Params()
    name, key, of = fresh(docs, "spans"), fresh(docs, "key_of_text"), fresh(docs, "found_for")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    k1, k2 = digest(t)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.octet_length(t).alias("stop")))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    found = spans(docs, p, text).where("n > 1 or spans is not null").select(F.struct("k1", "k2").alias(of), F.struct("n", "spans").alias(name))
    both = docs.withColumn(key, F.struct(k1.alias("k1"), k2.alias("k2"))).join(found, F.col(key) == F.col(of), "left")
    runs = (F.when(F.octet_length(t) < p.length, none).when(F.col(name)["n"] > 1, whole).otherwise(F.coalesce(F.col(name)["spans"], none)))
    return both.withColumn(name, runs).drop(key, of), name


def remove(docs: DataFrame, p: Params | None = None, text: str = "text") -> DataFrame:
    """``docs`` without the repeated passages, with the same columns and rows; a text may become empty, null stays.

    Bytes are removed, so a character of which a part is removed loses the rest as well, and what remains is
    always valid text.
    """
    marked, name = mark(docs, p, text)
    data = F.col(f"`{text}`").cast("binary")
    left = remaining(data, whole_characters(data, F.col(name))).cast("string")
    new = F.when((F.size(name) == 0) | F.col(f"`{text}`").isNull(), F.col(f"`{text}`")).otherwise(left)
    return marked.withColumn(text, new).drop(name)


def whole_characters(data: Column, found: Column) -> Column:
    """The spans, each widened to the whole characters that it touches, by three bytes at most."""
    def inside(at: Column) -> Column:
        byte = F.substring(data, at + 1, F.lit(1))
        return (at > 0) & (F.octet_length(byte) == 1) & (byte >= F.lit(b"\x80")) & (byte < F.lit(b"\xc0"))

    def edge(at: Column, way: int) -> Column:
        a, b, c = at + way, at + 2 * way, at + 3 * way
        return F.when(~inside(at), at).when(~inside(a), a).when(~inside(b), b).otherwise(c)

    return F.transform(found, lambda s: F.struct(edge(s["start"], -1).alias("start"), edge(s["stop"], 1).alias("stop")))
