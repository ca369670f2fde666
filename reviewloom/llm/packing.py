"""Filling containers of a fixed number of tokens with whole documents that belong together.

Lexical retrieval packing: the documents are dealt to shards of bounded size, each with its own BM25 inverted index. A
seed document retrieves its nearest unused neighbours, which fill its container in order of their score while they
fit; what room is left goes to the largest unused documents that still fit. Seeds are taken largest first, so the small
documents last to fill the gaps.

A task reads a range of documents and cuts it into shards while it streams; the number of ranges follows from bytes.

Document frequencies are counted over the whole collection, in 2^16 hash buckets, so what every task gets has a fixed
size. A shard is a range of (topic, id), the topic being a minwise hash of a document's most distinctive terms: documents
of one topic meet in a shard, and a topic of any size spreads over as many shards as it needs.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.arrow_tokens import encode_batch, hash_strings, mix64, row_token_counts
from reviewloom.llm.encode import Encoder, tokenizer_path
from reviewloom.session import shuffle_partitions, stash

CAPACITY = 2048
SHARD = 2048
BUCKETS = 1 << 16
K1, B = 1.2, 0.75
#: Bytes of term lists a task reads.
TASK_BYTES = 1 << 27
#: So many of a document's rarest terms make its topic.
TOPIC_TERMS = 16


def _measure(path: str):
    """(id, n_tokens, terms, tfs): size in tokens of the vocabulary, hashed terms and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.load(path)
        for b in batches:
            n = [len(enc.whole(t)) if t else 0 for t in b.column(1).to_pylist()]
            row, code, words = encode_batch(b.column(1))
            bucket = (hash_strings(words) >> np.uint64(48)).astype(np.int64)
            r, c, tf = row_token_counts(row, bucket[code] if len(code) else code, BUCKETS)
            offsets = pa.array(np.searchsorted(r, np.arange(b.num_rows + 1)).astype(np.int32))
            yield pa.record_batch(
                [b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))],
                names=["id", "n_tokens", "terms", "tfs"],
            )

    return run


def _topics(idf: np.ndarray):
    """Adds the topic of each row; rows without terms have topic 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, off = _lists(b.column(2))
            topic = np.zeros(b.num_rows, dtype=np.int64)
            for i in range(b.num_rows):
                t = flat[off[i] : off[i + 1]]
                if len(t):
                    top = t[np.argsort(-idf[t], kind="stable")[:TOPIC_TERMS]]
                    topic[i] = int(mix64(top.astype(np.uint64) + np.uint64(1)).min() >> np.uint64(1))
            yield pa.record_batch([*b.columns, pa.array(topic)], names=["id", "n_tokens", "terms", "tfs", "topic"])

    return run


def _lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.asarray(a.offsets, dtype=np.int64)
    return np.asarray(a.values, dtype=np.int64)[off[0] : off[-1]], off - off[0]


class Shard:
    """BM25 index over the items of one shard, and their packing."""

    def __init__(self, flat: np.ndarray, tf: np.ndarray, off: np.ndarray, idf: np.ndarray, mean_length: float):
        self.flat, self.off, n = flat, off, len(off) - 1
        doc = np.repeat(np.arange(n), np.diff(off))
        length = np.bincount(doc, weights=tf, minlength=n)
        norm = K1 * (1 - B + B * length / max(mean_length, 1e-9))
        weight = idf[flat] * tf * (K1 + 1) / (tf + norm[doc])
        by = np.lexsort((doc, flat))
        self.docs, self.weights = doc[by], weight[by]
        terms, start = np.unique(flat[by], return_index=True)
        self.begin = dict(zip(terms.tolist(), start.tolist()))
        self.end = dict(zip(terms.tolist(), np.append(start[1:], len(by)).tolist()))

    def scores(self, item: int, n: int) -> np.ndarray:
        parts = [slice(self.begin[t], self.end[t]) for t in self.flat[self.off[item] : self.off[item + 1]].tolist()]
        if not parts:
            return np.zeros(n)
        return np.bincount(np.concatenate([self.docs[p] for p in parts]), weights=np.concatenate([self.weights[p] for p in parts]), minlength=n)

    def pack(self, size: np.ndarray, capacity: int) -> list[list[int]]:
        """Containers of item numbers; every item in exactly one, each of at most `capacity`."""
        n = len(size)
        unused = np.ones(n, dtype=bool)
        by_size = np.lexsort((np.arange(n), size)).tolist()  # ascending
        sizes = size[by_size].tolist()
        out = []
        top = n - 1
        while True:
            while top >= 0 and not unused[by_size[top]]:
                top -= 1
            if top < 0:
                return out
            seed = by_size[top]
            box, room = [seed], capacity - int(size[seed])
            unused[seed] = False
            if room > 0:
                s = np.where(unused & (size <= room), self.scores(seed, n), 0.0)
                for k in np.argsort(-s, kind="stable").tolist():
                    if s[k] <= 0 or room <= 0:
                        break
                    if size[k] <= room:
                        box.append(k)
                        unused[k] = False
                        room -= int(size[k])
            # the largest that fit
            at = bisect_right(sizes, room) - 1
            while at >= 0:
                k = by_size[at]
                if unused[k] and sizes[at] <= room:
                    box.append(k)
                    unused[k] = False
                    room -= sizes[at]
                    at = min(at, bisect_right(sizes, room, 0, at + 1)) - 1
                else:
                    at -= 1
            out.append(box)


def _pack(capacity: int, idf: np.ndarray, mean_length: float, shard_docs: int):
    schema = pa.schema([("container_id", pa.int64()), ("id", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64())])

    def one(parts: list, base: int) -> tuple[pa.RecordBatch, int]:
        """The containers of a shard, numbered from base, and how many."""
        t = pa.Table.from_batches(parts).combine_chunks()
        ids, n_tokens = np.asarray(t["id"]), np.asarray(t["n_tokens"])
        (flat, off), (tf, _) = _lists(t["terms"].chunk(0)), _lists(t["tfs"].chunk(0))
        # what a document leaves after its full containers is its item
        full = np.where(n_tokens > capacity, n_tokens // capacity, 0)
        rest = n_tokens - full * capacity
        item = np.flatnonzero((rest > 0) | (full == 0))
        shard = Shard(flat, tf, off, idf, mean_length)
        # all rows stay in the index, those without an item are never unused
        size = np.where(np.isin(np.arange(len(ids)), item), rest, capacity + 1)
        boxes = shard_boxes(shard, size, item, capacity)
        box_no = 0
        rows = []
        n_parts = full + ((rest > 0) | (full == 0))
        for k in np.flatnonzero(full):
            for p in range(int(full[k])):
                rows.append((base + box_no, int(ids[k]), p, int(n_parts[k]), p * capacity, capacity))
                box_no += 1
        for box in boxes:
            for k in box:
                rows.append((base + box_no, int(ids[k]), int(full[k]), int(n_parts[k]), int(full[k]) * capacity, int(rest[k])))
            box_no += 1
        cols = list(zip(*rows))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema), box_no

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        for shard in cut_shards(batches, shard_docs):
            out, n = one(shard, base)
            base += n
            yield out

    return run


def cut_shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list]:
    """Shards of `size` rows from a stream; what is left at the end makes one shard, or two of equal size. Holds two shards."""
    held: list = []
    n = 0

    def take(k: int) -> list:
        nonlocal n
        out, left = [], k
        while left:
            b = held.pop(0)
            if b.num_rows > left:
                held.insert(0, b.slice(left))
                b = b.slice(0, left)
            out.append(b)
            left -= b.num_rows
        n -= k
        return out

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        while n >= 2 * size:
            yield take(size)
    if n > size + size // 2:
        yield take(n // 2)
    if n:
        yield take(n)


def shard_boxes(shard: Shard, size: np.ndarray, item: np.ndarray, capacity: int) -> list[list[int]]:
    """Packs the items only; documents that fill their containers exactly have none."""
    if len(item) == len(size):
        return shard.pack(size, capacity)
    boxes = shard.pack(np.where(size > capacity, capacity, size), capacity)
    left = set(item.tolist())
    return [b for b in ([k for k in box if k in left] for box in boxes) if b]


def pack_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, shard_docs: int = SHARD, path: str | None = None) -> DataFrame:
    """(container_id, id, part, parts, start, n_tokens): where each document, or each part of one, goes.

    A document of more than `capacity` tokens is cut into full containers and a rest, which is packed like any other
    item; no other document is cut. Null and empty texts have 0 tokens and take a place without room. Ids must be unique
    bigints, and rows without one are left out; an empty table gives an empty table; other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    path = path or tokenizer_path()
    src = docs.filter(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    fields = "id bigint, n_tokens bigint, terms array<int>, tfs array<int>"
    m = stash(src.mapInArrow(_measure(path), fields), "measured")
    terms = F.coalesce(F.sum(F.size("terms")), F.lit(0))
    n, total, n_terms = m.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.aggregate("tfs", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0)), terms).head()
    df = np.zeros(BUCKETS)
    for x in m.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():  # 2^16 rows at most
        df[x["t"]] = x["n"]
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    with_topic = m.mapInArrow(_topics(idf), fields + ", topic bigint")
    # as many tasks as bytes ask for, or as the cluster has, but none of less than a shard
    tasks = max(-(-n_terms * 8 // TASK_BYTES), min(shuffle_partitions(docs.sparkSession), n // shard_docs), 1)
    placed = with_topic.repartitionByRange(tasks, "topic", "id").sortWithinPartitions("topic", "id").select("id", "n_tokens", "terms", "tfs")
    out = placed.mapInArrow(_pack(capacity, idf, total / n if n else 0.0, shard_docs), "container_id bigint, id bigint, part int, parts int, start bigint, n_tokens bigint")
    return out.withColumnRenamed("id", id)
