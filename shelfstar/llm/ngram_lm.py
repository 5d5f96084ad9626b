"""Language-model scores of documents by stupid backoff over the corpus's own n-gram counts.

The corpus is dealt into blocks of documents. A block's distinct unigrams and bigrams go, with their counts,
to shards by hash: the count tables. Each shard sums the counts of equal n-grams and joins the totals back to
the blocks that asked; there they meet the documents again, and a document's scores are summed. An n-gram
of any frequency is one entry per block, and a row holds a block's part of a shard, sorted and packed.

A document is scored by the counts of all other documents (its own are taken off), so that backoff matters:
score(w | v) = c(v w) / c(v) if the others have v w, else alpha c(w) / N, else alpha^2 / N.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """``alpha``: backoff factor; ``block_bytes``: text of a block; ``blocks_per_shard``: blocks whose n-grams a shard gets."""

    alpha: float = 0.4
    block_bytes: int = 4 << 20
    blocks_per_shard: float = 4.0


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Stands for the empty n-gram, which every word counts for.
_EMPTY = np.uint64(0)


def word_hashes(data: bytes) -> list[int]:
    return [xxhash.xxh64_intdigest(w) for w in data.translate(_LOWER).split()]


class Block:
    """The n-grams of some documents: hashes of words and pairs, by document."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array):
        found = [word_hashes(x.as_py() or b"") for x in texts]
        self.sizes = np.array([len(f) for f in found], np.int64)
        self.doc = np.repeat(np.arange(len(found)), self.sizes)
        self.words = np.array([h for f in found for h in f], np.uint64)
        self.words[self.words == _EMPTY] = np.uint64(1)
        pairs = self.words[:-1] * _PRIME + (self.words[1:] ^ (self.words[1:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        pairs ^= pairs >> np.uint64(32)
        self.inner = self.doc[:-1] == self.doc[1:]  # the pairs inside a document
        self.pairs = np.where(pairs == _EMPTY, np.uint64(1), pairs)[self.inner]
        every = np.concatenate([np.array([_EMPTY]), self.words, self.pairs])
        self.grams, self.place, self.counts = np.unique(every, return_inverse=True, return_counts=True)
        self.counts[0] = len(self.words)

    def cuts(self, shards: int) -> np.ndarray:
        """Where the shards' ranges of hashes begin in ``grams``."""
        edges = [(s << 64) // shards for s in range(shards)]
        return np.r_[np.searchsorted(self.grams, np.array(edges, np.uint64)), len(self.grams)]


def pack(values: np.ndarray) -> bytes:
    """Whole numbers (uint64) in as many bytes each as the largest needs."""
    width = max(1, (int(values.max(initial=np.uint64(0))).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    whole = np.zeros((len(raw), 8), np.uint8)
    whole[:, :data[0]] = raw
    return whole.reshape(-1).view("<u8")


def pack_sorted(hashes: np.ndarray) -> bytes:
    return pack(np.diff(hashes, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return unpack(data).cumsum(dtype=np.uint64)


def _count(shards: int):
    def run(t: pa.Table) -> pa.Table:
        b = Block(t.column("text"))
        cuts = b.cuts(shards)
        full = np.flatnonzero(np.diff(cuts))
        return pa.table({"shard": pa.array(full.astype(np.int32)), "block": pa.array(np.full(len(full), t.column("block")[0].as_py(), np.int32)),
                         "grams": pa.array([pack_sorted(b.grams[cuts[s]:cuts[s + 1]]) for s in full], pa.binary()),
                         "counts": pa.array([pack(b.counts[cuts[s]:cuts[s + 1]]) for s in full], pa.binary())})

    return run


def _total(t: pa.Table) -> pa.Table:
    """A shard: the corpus count of every n-gram, sent back to each block in the order it asked."""
    asked = [unpack_sorted(x.as_py()) for x in t.column("grams")]
    grams, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.zeros(len(grams), np.int64)
    np.add.at(total, place, np.concatenate([unpack(x.as_py()) for x in t.column("counts")]).astype(np.int64))
    ends = np.cumsum([len(a) for a in asked])
    return pa.table({"shard": t.column("shard"), "block": t.column("block"),
                     "totals": pa.array([pack(total[place[e - len(a):e]]) for a, e in zip(asked, ends)], pa.binary())})


def _score(alpha: float):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        b = Block(docs.column("text"))
        back = back.sort_by("shard")
        totals = np.concatenate([np.zeros(0, np.uint64), *[unpack(x.as_py()) for x in back.column("totals")]]).astype(np.int64)
        words, pairs = b.place[1:1 + len(b.words)], b.place[1 + len(b.words):]

        def others(doc: np.ndarray, gram: np.ndarray) -> np.ndarray:
            """Count of each occurrence's n-gram outside its own document."""
            _, place, own = np.unique(doc * len(b.grams) + gram, return_inverse=True, return_counts=True)
            return totals[gram] - own[place]

        alone = others(b.doc, words)
        rest = (totals[0] - b.sizes).clip(1)[b.doc]
        step = np.log(np.where(alone > 0, alone, alpha) / rest)
        backed = np.log(alpha) + step
        first = np.r_[True, ~b.inner] if len(b.words) else np.zeros(0, bool)
        both = others(b.doc[1:][b.inner], pairs) if len(b.words) else np.zeros(0)
        seen = both > 0
        at = np.flatnonzero(~first)
        step[at] = np.where(seen, np.log(np.where(seen, both, 1) / np.maximum(alone[at - 1], 1)), backed[at])
        sums = np.bincount(b.doc, step, len(b.sizes))
        hits = np.bincount(b.doc[at], seen, len(b.sizes)).astype(np.int64)
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": b.sizes, "n_known_pairs": hits, "log_score": pa.array(sums),
                         "mean_log_score": pa.array(sums / np.maximum(b.sizes, 1), mask=b.sizes == 0)})

    return run


def scores(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """(doc_id, n_words, n_known_pairs, log_score, mean_log_score) for every row of ``docs``.

    Words are runs of non-space with A-Z lower-cased; log_score sums natural logarithms over a text's words,
    the first by its unigram. A corpus of one document backs off all the way (N counts as 1). Null and empty
    texts have no words, score 0 and a null mean. Rows are documents of their own, repeated ones too, and
    rows without a doc_id are scored alike. Other columns are ignored.
    """
    p = p or Params()
    text = F.col("text").cast("binary")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-size // p.block_bytes))
    shards = max(1, round(blocks / p.blocks_per_shard))
    dealt = docs.select("doc_id", text.alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    asked = dealt.groupBy("block").applyInArrow(_count(shards), "shard int, block int, grams binary, counts binary")
    back = asked.groupBy("shard").applyInArrow(_total, "shard int, block int, totals binary")
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        _score(p.alpha), "doc_id long, n_words long, n_known_pairs long, log_score double, mean_log_score double")
