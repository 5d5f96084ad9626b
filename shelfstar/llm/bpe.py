"""BPE encoding and decoding of whole texts with a given tokenizer file.

Tree concatenation: a long text is halved until its pieces are short, the pieces are encoded in parallel, and
neighbours are joined pairwise up the tree. A join encodes a window around it anew and grows the window until
the tokens on both sides agree exactly with those of the pieces; only what lies inside is replaced.

Why this is exact: a piece's split into words depends on what follows only near its end, and one that starts
inside a text falls into step with the text at the first common boundary; agreement of tokens and word
starts on both sides of the join shows this. Inside one long word, a sequence of tokens is the encoding if and
only if each adjacent pair is (a property of BPE), and pairs across the window's edges are pairs of a piece.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfstar.llm.common import digest

#: Bytes of the longest piece that is encoded at once, and of the first window on each side of a join.
LEAF, WINDOW = 32768, 64


#: Fixed value: how byte-level tokenizers split a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as its character, the others as characters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """A byte-level BPE tokenizer file (``tokenizers`` JSON), run by a faster library with the same results.

    The file must merge in the order of its ids, split by PATTERN and change nothing else; others are refused.
    """

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and not spec["normalizer"] and not model.get("dropout") and before.get("type") == "ByteLevel"
                 and before.get("use_regex", True) and not before.get("add_prefix_space"))
        byte = _bytes_of_characters()
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}
        ids = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if not plain or ids != sorted(ids) or len(ranks) != len(model["vocab"]):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bpe = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.lengths = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.lengths[i] = len(token)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.word = regex.compile(PATTERN)

    def encode(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, allowed_special="all").astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        return self.bpe.decode_bytes(ids).decode("utf-8", "replace")

    def word_starts(self, text: str) -> np.ndarray:
        """Places in bytes where words and special tokens of ``text`` start."""
        sizes, at = [], 0
        for m in [*(self.cut.finditer(text) if self.cut else ()), None]:
            sizes += [len(w.encode()) for w in self.word.findall(text[at:m.start() if m else len(text)])]
            if m:
                sizes.append(len(m[0].encode()))
                at = m.end()
        return np.cumsum([0, *sizes[:-1]], dtype=np.int64)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


class Piece:
    """An encoded text: its bytes, token ids, ends of the tokens in bytes, and which tokens start a word."""

    def __init__(self, data: bytes, ids: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.data, self.ids, self.ends, self.first = data, ids, ends, first

    def starts(self) -> np.ndarray:
        return np.r_[0, self.ends[:-1]] if len(self.ends) else self.ends

    def clean(self, at: np.ndarray) -> np.ndarray:
        """Of byte positions, those between characters where a word may be cut (no apostrophe follows)."""
        after = np.frombuffer(self.data + b"\0", np.uint8)[at]
        return ((after & 0xC0) != 0x80) & (after != 0x27)


def encode_piece(path: str, data: bytes) -> Piece:
    c, text = codec(path), data.decode()
    ids = c.encode(text)
    ends = c.lengths[ids].cumsum()
    return Piece(data, ids, ends, np.isin(np.r_[0, ends[:-1]][:len(ids)], c.word_starts(text)))


def halves(data: bytes, leaf: int) -> list[bytes]:
    """The leaves of the tree: halves of halves, cut between characters, of at most ``leaf`` bytes."""
    if len(data) <= max(leaf, 8):
        return [data]
    at = len(data) // 2
    while data[at] & 0xC0 == 0x80:
        at -= 1
    return halves(data[:at], leaf) + halves(data[at:], leaf)


def join(path: str, left: Piece, right: Piece) -> Piece:
    if not left.data or not right.data:
        return right if not left.data else left
    w, data, size = WINDOW, left.data + right.data, len(left.data)
    ls, rs = left.starts(), right.starts()
    while True:
        i, j = 0, len(right.ids)
        if size > 2 * w:  # the last token start before the window, of a word if one is near
            ok = np.flatnonzero((ls <= size - 2 * w) & left.clean(ls))
            words = ok[left.first[ok] & (ls[ok] > size - 4 * w)]
            i = int(words[-1] if len(words) else ok[-1] if len(ok) else 0)
        if len(right.data) > 2 * w:
            ok = np.flatnonzero((rs >= 2 * w) & right.clean(rs))
            words = ok[right.first[ok] & (rs[ok] < 4 * w)]
            j = int(words[0] if len(words) else ok[0] if len(ok) else j)
        a, b = int(ls[i]), int(rs[j]) if j < len(rs) else len(right.data)
        new = encode_piece(path, data[a:size + b])
        n_left = int(((left.ends <= size - w) & (np.arange(len(left.ids)) >= i)).sum()) if a else 0
        n_right = int(((rs >= w) & (np.arange(len(right.ids)) < j)).sum()) if b < len(right.data) else 0
        agree = ((a == 0 or n_left > 0) and (b == len(right.data) or n_right > 0) and n_left + n_right <= len(new.ids)
                 and np.array_equal(new.ids[:n_left], left.ids[i:i + n_left])
                 and np.array_equal(new.first[1:n_left], left.first[i + 1:i + n_left])
                 and np.array_equal(new.ids[len(new.ids) - n_right:], right.ids[j - n_right:j])
                 and np.array_equal(new.first[len(new.ids) - n_right:], right.first[j - n_right:j]))
        if agree or (a == 0 and b == len(right.data)):
            first = new.first.copy()
            if a:
                first[0] = left.first[i]
            ends = np.r_[left.ends[:i], a + new.ends, size + right.ends[j:]]
            return Piece(data, np.r_[left.ids[:i], new.ids, right.ids[j:]], ends, np.r_[left.first[:i], first, right.first[j:]])
        w *= 4


def join_all(path: str, pieces: list[Piece]) -> Piece:
    """Join neighbours level by level."""
    while len(pieces) > 1:
        pieces = [join(path, *pieces[i:i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays as a list column, without a Python object for each element."""
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0), kind))


#: Texts that are held as Python objects at once.
SOME = 256


def _coded(c: Codec, found: list[np.ndarray], decoded: bool) -> pa.Array:
    ids = _lists(found, pa.int32())
    if not decoded:
        return pa.StructArray.from_arrays([ids], ["ids"])
    return pa.StructArray.from_arrays([ids, pa.array([c.decode(x.tolist()) for x in found], pa.string())], ["ids", "decoded"])


def _encode_whole(path: str, kind: str, decoded: bool):
    @F.arrow_udf(kind)
    def run(text: pa.Array) -> pa.Array:
        c = codec(path)
        done = [_coded(c, [c.encode(x.as_py()) for x in text.slice(at, SOME)], decoded) for at in range(0, len(text), SOME)]
        return pa.concat_arrays(done) if done else _coded(c, [], decoded)

    return run


def _split(leaf: int):
    def run(batches):
        for b in batches:
            rows, at, parts = [], [], []
            for r, x in enumerate(b.column("text")):
                found = halves(x.as_py().encode(), leaf)
                rows += [r] * len(found)
                at += range(len(found))
                parts += found
            b = b.select(["k1", "k2"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array(parts, pa.binary())], ["k1", "k2", "at", "part"])

    return run


def _encode_parts(path: str):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                done = [encode_piece(path, x.as_py()) for x in some.column("part")]
                yield pa.RecordBatch.from_arrays([*some.columns, _lists([p.ids for p in done], pa.int32()), _lists([p.first for p in done], pa.bool_())],
                                                 [*some.schema.names, "ids", "first"])

    return run


def _join_text(path: str, decoded: bool):
    def run(t: pa.Table) -> pa.Table:
        """Rows: the encoded pieces of one text."""
        t = t.sort_by("at")
        pieces = {}
        for n, part, ids, first in zip(t.column("at").to_pylist(), t.column("part"), t.column("ids"), t.column("first")):
            if n not in pieces:
                ids = ids.values.to_numpy()
                pieces[n] = Piece(part.as_py(), ids, codec(path).lengths[ids].cumsum(), first.values.to_numpy(zero_copy_only=False))
        ids = join_all(path, [pieces[n] for n in sorted(pieces)]).ids
        return pa.table({"k1": t.column("k1")[:1], "k2": t.column("k2")[:1], "coded": _coded(codec(path), [ids], decoded)})

    return run


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", leaf: int = LEAF, decoded: str | None = None) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``ids`` (array<int>): the encoding without added special tokens.

    Texts of at most ``leaf`` bytes are encoded where they are. Longer ones are dealt out piece by piece, once
    per distinct text, and joined again; each row then takes the result of its text. Null counts as empty.
    Special tokens spelled out in a text are recognised, as the tokenizer does. ``decoded`` names a further
    column: the text that the ids decode to, read back by the task that made them. ``ids`` and ``decoded``
    replace columns of that name; all other columns and repeated rows stay.
    """
    names = [c for c in docs.columns if c not in (text, ids, decoded)]
    rest, kind = [F.col(f"`{c}`") for c in names], f"struct<ids:array<int>{',decoded:string' if decoded else ''}>"
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = F.octet_length(t)
    made = [F.col("_coded")["ids"].alias(ids), *([F.col("_coded")["decoded"].alias(decoded)] if decoded else [])]
    own = F.struct(*rest).alias("_row") if rest else F.struct(F.lit(0).alias("none")).alias("_row")
    short = docs.where(size <= leaf).select(own, _encode_whole(path, kind, bool(decoded))(t).alias("_coded"))
    k1, k2 = digest(t)
    long = docs.where(size > leaf)
    whole = long.select(k1.alias("k1"), k2.alias("k2"), t.alias("text"))
    parts = whole.mapInArrow(_split(leaf), "k1 long, k2 long, at int, part binary")
    parts = parts.dropDuplicates(["k1", "k2", "at"])  # deals the pieces of a text to different tasks
    done = parts.mapInArrow(_encode_parts(path), "k1 long, k2 long, at int, part binary, ids array<int>, first array<boolean>")
    joined = done.groupBy("k1", "k2").applyInArrow(_join_text(path, bool(decoded)), f"k1 long, k2 long, coded {kind}").select(
        F.struct("k1", "k2").alias("_of"), F.col("coded").alias("_coded"))
    rows = long.select(own, F.struct(k1.alias("k1"), k2.alias("k2")).alias("_key"))
    both = rows.join(joined, F.col("_key") == F.col("_of")).select("_row", "_coded")
    return short.unionByName(both).select(*[F.col("_row")[c].alias(c) for c in names], *made)


def decode(path: str, ids: Column) -> Column:
    """The text of token ids, special tokens included; null ids give an empty text."""
    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([codec(path).decode(x.as_py() or []) for x in col], pa.string())

    return run(ids)
