"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Tree concatenation: texts longer than a leaf are cut into leaves that are encoded in parallel, wherever the cuts fall.
Neighbouring encodings are then joined pairwise up a binary tree. At a join only a window is encoded again: first the
pre-tokens around it, from a boundary that the left side has settled to one that the right side has too; and inside a
pre-token that itself spans the join, a window of BPE tokens that doubles until its outer tokens on both sides equal
the ones already there. A BPE sequence is the encoding of its text exactly if each neighbouring pair of tokens is, so
the joined ids equal those of the whole text encoded at once.
"""

from __future__ import annotations

import base64
import bisect
import dataclasses
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed value: the pattern that splits text before the merges of the public vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: How far behind a match's end the pattern may look (the longest contraction and its lookahead).
_LOOKAHEAD = 4

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
LEAF_CHARS = 16_384

_encoders: dict[str, Encoder] = {}


def tokenizer_path(name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> str:
    return os.path.join(directory, f"{name}.tiktoken")


@dataclasses.dataclass
class Encoded:
    """ids of a text, and where its pre-tokens start (code points)."""

    text: str
    ids: np.ndarray
    starts: np.ndarray


class Encoder:
    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.encoding._encode_single_piece
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.bytes: dict[int, bytes] = {}
        for k, v in ranks.items():
            self.width[v] = len(k)
            self.bytes[v] = k
        self.pattern = regex.compile(PATTERN)

    @staticmethod
    def load(path: str) -> Encoder:
        """One per worker process."""
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def whole(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def leaf(self, text: str) -> Encoded:
        starts = np.fromiter((m.start() for m in self.pattern.finditer(text)), dtype=np.int64)
        return Encoded(text, np.array(self.whole(text), dtype=np.int32), starts)

    def _token_at(self, e: Encoded, char: int) -> int:
        """Index of the token that begins at a code point on a pre-token boundary."""
        n = len(e.text[:char].encode())
        return int(np.searchsorted(np.cumsum(self.width[e.ids]), n, side="right")) if n else 0

    def _tokens_behind(self, e: Encoded, char: int) -> int:
        """The same, counted from the end."""
        n, i = len(e.text[char:].encode()), len(e.ids)
        while n > 0:
            i -= 1
            n -= int(self.width[e.ids[i]])
        return i

    def _tokens_before(self, e: Encoded, char: int) -> int:
        n, i = len(e.text[:char].encode()), 0
        while n > 0:
            n -= int(self.width[e.ids[i]])
            i += 1
        return i

    def bpe_join(self, left: list[int], right: list[int], window: int = 8) -> list[int]:
        """ids of one pre-token from those of its two parts."""
        k = window
        while True:
            a, b = left[-k:], right[:k]
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            w = self.piece(b"".join(self.bytes[t] for t in a + b))
            if (whole_left or w[:2] == a[:2]) and (whole_right or w[-2:] == b[-2:]):
                return left[: len(left) - len(a)] + w + right[len(b) :]
            k *= 2

    def join(self, x: Encoded, y: Encoded) -> Encoded:
        m = len(x.text)
        if not m or not y.text:
            return y if not m else x
        text = x.text + y.text
        i = int(np.searchsorted(x.starts, m - _LOOKAHEAD, side="right")) - 1
        a = int(x.starts[i]) if i >= 0 else 0
        # split again from a until a boundary that the right side has too
        right_starts, at, middle = y.starts + m, a, []
        while at < len(text):
            end = self.pattern.match(text, at).end()
            middle.append((at, end))
            at = end
            j = int(np.searchsorted(right_starts, at))
            if at >= m and (at == len(text) or (j < len(right_starts) and right_starts[j] == at)):
                break
        b = at
        left_ids, right_ids = x.ids[: self._tokens_behind(x, a)], y.ids[self._tokens_before(y, b - m) :]
        new: list[int] = []
        for s, e in middle:
            i = bisect.bisect_left(x.starts, s)
            spans = s < m < e and i == len(x.starts) - 1 and x.starts[i] == s
            # one pre-token in either part: join the BPE tokens themselves
            if spans and e - s > 64 and int(np.searchsorted(right_starts, e)) == 1:
                new += self.bpe_join(x.ids[self._tokens_behind(x, s) :].tolist(), y.ids[: self._tokens_before(y, e - m)].tolist())
            else:
                new += self.piece(text[s:e].encode())
        starts = np.concatenate([x.starts[x.starts < a], [s for s, _ in middle], right_starts[right_starts >= b]]).astype(np.int64)
        return Encoded(text, np.concatenate([left_ids, np.array(new, dtype=np.int32), right_ids]), starts)

    def tree(self, leaves: list[Encoded]) -> Encoded:
        while len(leaves) > 1:
            pairs = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
            leaves = pairs
        return leaves[0]


def _lists(ids: list) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def encode_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens.

    Null and empty texts give an empty list. Texts of up to leaf_chars code points are encoded where they are read,
    without any exchange; only the leaves of longer ones travel, so one very long text keeps no single task busy.
    An empty table gives an empty table; other columns are ignored. The id may be null or repeated in short texts; long
    texts are put together again by id and content hash, so equal rows stay as many as they are.
    """
    path = path or tokenizer_path()
    src = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    it = src.schema["id"].dataType.simpleString()
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[it]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.load(path)
        for b in batches:
            yield pa.record_batch([b.column(0), _lists([enc.whole(t) if t else [] for t in b.column(1).to_pylist()])], names=["id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts = [t[k : k + leaf_chars] for k in range(0, len(t), leaf_chars)]
                n = len(parts)
                yield pa.record_batch([pa.array([i] * n, arrow_id), pa.array([u] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts)], names=["id", "u", "pos", "part"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.load(path)
        for b in batches:
            es = [enc.leaf(t) for t in b.column(3).to_pylist()]
            yield pa.record_batch([*b.columns, _lists([e.ids for e in es]), _lists([e.starts for e in es])], names=["id", "u", "pos", "part", "ids", "starts"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.load(path)
        for b in batches:
            out = []
            for row in b.column(1).to_pylist():
                row.sort(key=lambda r: r["pos"])
                es = [Encoded(r["part"], np.array(r["ids"], dtype=np.int32), np.array(r["starts"], dtype=np.int64)) for r in row]
                out.append(enc.tree(es).ids)
            yield pa.record_batch([b.column(0), _lists(out)], names=["id", "ids"])

    long_ = F.coalesce(F.length("text") > leaf_chars, F.lit(False))
    out_schema = f"id {it}, ids array<int>"
    a = src.filter(~long_).mapInArrow(short, out_schema)
    # u tells rows with the same id apart
    numbered = src.filter(long_).withColumn("u", F.monotonically_increasing_id())
    parts = numbered.mapInArrow(cut, f"id {it}, u bigint, pos int, part string").repartition("u", "pos")
    enc = parts.mapInArrow(leaves, f"id {it}, u bigint, pos int, part string, ids array<int>, starts array<int>")
    g = enc.groupBy("u").agg(F.first("id").alias("id"), F.collect_list(F.struct("pos", "part", "ids", "starts")).alias("leaves"))
    b = g.select("id", "leaves").mapInArrow(joined, out_schema)
    return a.unionAll(b).select(F.col("id").alias(id), "ids")
