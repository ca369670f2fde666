"""Near-duplicate records by weighted minwise signatures and banded joining, with an exact check.

DartMinHash: every element throws darts, drawn from hashes of the element alone, into the plane weight x rank, in cells
of equal area with one dart each on average. A dart counts for a record if it lies below the element's weight there; it
hits one of k coordinates, and each coordinate keeps its earliest dart. A record with total weight W needs darts up to
rank (k ln k)/W only, so a signature costs about k ln k darts however many elements there are. Two records agree in a
coordinate with the probability of their weighted Jaccard similarity.

An element is a run of consecutive tokens. All weigh 1, since the similarity asked for counts every run alike: with
weights that fall with a run's frequency, records made from a common template with edits of their own are not found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.arrow_tokens import encode_batch, hash_strings, mix64
from reviewloom.session import cut, shuffle_partitions, stash

SHINGLE = 3
MIN_TOKENS = 25
THRESHOLD = 0.5
COORDINATES, BANDS, ROWS = 80, 80, 4
#: Buckets of the banded join up to this size are paired in one task, larger ones in blocks of this size.
BLOCK = 256
#: Band rows per task of the banded join.
ROWS_PER_TASK = 1_000_000
#: A task holds up to so many band rows to leave out keys that stand alone.
HOLD = 4_000_000
#: Exact copies of a text up to this number are written out as pairs; more as links to the first of them.
EXPAND = 32

#: Weights are cut at 1/2 and 1/4; a level's cells are as tall as they are narrow, so each has area 1.
_LEVELS = ((0.5, 1.0, 2), (0.25, 0.5, 4), (0.0, 0.25, 4))
_TALLEST = 4
#: Darts of a cell by the first 16 bits of its hash: the Poisson distribution of mean 1.
_DARTS = np.searchsorted(np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040], dtype=float)), (np.arange(1 << 16) + 0.5) / (1 << 16))
#: Cells handled at a time, so that the arrays stay in the processor's cache.
_CELLS = 60_000
_U64 = np.uint64


def batch_shingles(texts: pa.Array, size: int, min_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct runs of `size` tokens, sorted by row and hash; rows of fewer tokens have none."""
    row, code, words = encode_batch(texts)
    if len(row) == 0:
        return np.zeros(0, np.int64), np.zeros(0, _U64)
    h = hash_strings(words)[code]
    n = np.bincount(row, minlength=len(texts))
    m = len(row) - size + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U64)
    x = np.zeros(m, dtype=_U64)
    for i in range(size):
        x = mix64(x + h[i : i + m] + _U64(0x9E3779B97F4A7C15))
    ok = (row[:m] == row[size - 1 :]) & (n[row[:m]] >= min_tokens)
    r, x = row[:m][ok], x[ok]
    by = np.lexsort((x, r))
    r, x = r[by], x[by]
    first = np.ones(len(r), dtype=bool)
    first[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return r[first], x[first]


def dart_signatures(doc: np.ndarray, x: np.ndarray, w: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """(n_docs, k) dart ids. doc: 0-based, each with an element at least; x: element hashes; 0 < w <= 1."""
    sig = np.zeros((n_docs, k), dtype=_U64)
    best = np.full((n_docs, k), np.inf)
    total = np.bincount(doc, weights=w, minlength=n_docs)
    # ranks come in steps of the height of the tallest cell
    step = np.ceil((k * np.log(k) + 2 * k) / np.maximum(total, 1e-9) / _TALLEST).astype(np.int64)
    begin = np.zeros(n_docs, dtype=np.int64)
    active = np.ones(n_docs, dtype=bool)
    while active.any():
        todo = np.flatnonzero(active[doc])
        cost = np.cumsum(step[doc[todo]] * _TALLEST)
        edges = np.unique(np.searchsorted(cost, np.arange(0, cost[-1], _CELLS)))
        for a, b in zip(edges, [*edges[1:], len(todo)]):
            _throw(todo[a:b], doc, x, w, begin, step, k, sig, best)
        begin += step * active
        step = np.maximum(step // 2, 1)
        active = np.isinf(best).any(axis=1)
    return sig


def _throw(e, doc, x, w, begin, step, k, sig, best) -> None:
    """Darts of elements e in ranks [begin, begin+step) x the tallest cell; keeps the earliest of each coordinate."""
    we, de, xe = w[e], doc[e], x[e]
    darts, ranks, owners = [], [], []
    for level, (low, high, tall) in enumerate(_LEVELS):
        i = np.flatnonzero(we > low)
        per = step[de[i]] * (_TALLEST // tall)
        which = np.repeat(i, per)
        place = np.arange(len(which)) - np.repeat(np.cumsum(per) - per - begin[de[i]] * (_TALLEST // tall), per)
        cell = mix64(xe[which] + (place.astype(_U64) * _U64(len(_LEVELS)) + _U64(level + 1)) * _U64(0xD1B54A32D192ED03))
        count = _DARTS[(cell >> _U64(48)).astype(np.int64)]
        of = np.repeat(np.arange(len(cell)), count)
        number = np.arange(1, len(of) + 1) - np.repeat(np.cumsum(count) - count, count)
        # one hash gives all: coordinate, place in the weight range, place in the rank range
        dart = mix64(cell[of] + number.astype(_U64) * _U64(0x9FB21C651E98DF25))
        limit = np.clip((we - low) / (high - low) * 0x10000, 0, 0x10000).astype(np.int32)
        own = which[of]
        ok = np.flatnonzero(((dart >> _U64(24)) & _U64(0xFFFF)).astype(np.int32) < limit[own])
        dart = dart[ok]
        darts.append(dart)
        owners.append(de[own[ok]])
        ranks.append(tall * (place[of[ok]] + (dart & _U64(0xFFFFFF)).astype(np.float64) / 0x1000000))
    dart, d, rank = np.concatenate(darts), np.concatenate(owners), np.concatenate(ranks)
    if not len(dart):
        return
    target = d * k + (dart >> _U64(40)).astype(np.int64) % k
    from_, to = int(de[0]), int(de[-1]) + 1
    if len(dart) < 1 << 22 and (to - from_) * k < 1 << 20:
        # target, rank within the record's steps and number of the dart in one word, for one plain sort
        fine = ((rank - _TALLEST * begin[d]) * ((1 << 22) / (_TALLEST * step[d]))).astype(_U64)
        word = ((target - from_ * k).astype(_U64) << _U64(44)) | (fine << _U64(22)) | np.arange(len(dart), dtype=_U64)
        word.sort()
        t = word >> _U64(44)
        first = (word[np.concatenate([[True], t[1:] != t[:-1]])] & _U64(0x3FFFFF)).astype(np.int64)
    else:
        by = np.lexsort((rank, target))
        first = by[np.concatenate([[True], target[by][1:] != target[by][:-1]])]
    d, c = target[first] // k, target[first] % k
    better = rank[first] < best[d, c]
    d, c, first = d[better], c[better], first[better]
    sig[d, c] = dart[first]
    best[d, c] = rank[first]


def band_layout(k: int, bands: int, rows: int) -> np.ndarray:
    """(bands, rows) coordinates. Each round of k // rows bands uses every coordinate once, in another order, so that a
    signature serves more bands than it could be cut into."""
    strides = [x for x in range(1, k) if np.gcd(x, k) == 1]
    out: list[np.ndarray] = []
    for i in range(-(-bands // (k // rows))):
        stride = 1 if i == 0 else next(x for x in strides if x > rows + 2 * i)
        order = np.arange(k) * stride % k
        out += list(order[: k // rows * rows].reshape(-1, rows))
    return np.array(out[:bands])


def band_keys(sig: np.ndarray, layout: np.ndarray) -> np.ndarray:
    """(n, bands) keys: records share one if they agree in all coordinates of the band."""
    out = np.empty((len(sig), len(layout)), dtype=_U64)
    for b, coordinates in enumerate(layout):
        h = np.full(len(sig), mix64(np.array([b + 1], dtype=_U64))[0], dtype=_U64)
        for j in coordinates:
            h = mix64(h + sig[:, j])
        out[:, b] = h
    return out


def _identify(size: int, min_tokens: int):
    """Records long enough: (id, h1, h2, t1, t2, runs). h1 and h2 are a 128-bit hash of the set of runs, t1 and t2 one of the
    text; runs holds the sorted low 16 bits of every run's hash."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, x = batch_shingles(b.column(1), size, min_tokens)
            if not len(r):
                continue
            at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            h1 = np.add.reduceat(x, at)
            h2 = np.add.reduceat(mix64(x ^ _U64(0xA0761D6478BD642F)), at)
            rows = pa.array(r[at])
            t = np.frombuffer(b"".join(xxhash.xxh3_128_digest(v) for v in b.column(1).take(rows).to_pylist()), dtype=np.int64).reshape(-1, 2)
            low = (x & _U64(0xFFFF)).astype(np.uint16)
            short = np.sort((np.repeat(np.arange(len(at)), np.diff(np.append(at, len(x)))) << 16) | low).astype(np.uint16)
            offsets = np.append(at, len(x)) * 2
            runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(short.tobytes())]).cast(pa.binary())
            yield pa.record_batch([b.column(0).take(rows), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(t[:, 0]), pa.array(t[:, 1]), runs], names=["id", "h1", "h2", "t1", "t2", "runs"])

    return run


def _bands(size: int, min_tokens: int, k: int, layout: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                r, x = batch_shingles(b.column(1), size, min_tokens)
                if not len(r):
                    continue
                present, doc = np.unique(r, return_inverse=True)
                sig = dart_signatures(doc, x, np.ones(len(x)), len(present), k)
                keys = band_keys(sig, layout)
                ids = np.asarray(b.column(0))[present]
                yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, len(layout)))], names=["key", "id"])

    return run


def _packed(parts: int):
    """(part, keys, ids) of (key, id) rows: for each batch and partition one row of packed numbers.

    The partition follows from the key's upper 24 bits, the lower 40 travel: in a partition of a million rows two different
    keys coincide about once in two runs, which costs one comparison more. Ids ascend and travel as differences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, ids = np.asarray(b.column(0)).view(_U64), np.asarray(b.column(1))
            part = ((key >> _U64(40)) * _U64(parts) >> _U64(24)).astype(np.int64)
            by = np.lexsort((ids, part))
            part, ids = part[by], ids[by]
            low = key[by].view(np.uint8).reshape(-1, 8)[:, :5]
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            step = np.diff(ids, prepend=0)
            step[at] = ids[at]
            keys, steps = [], []
            for s, e in zip(at, np.append(at[1:], len(part))):
                keys.append(low[s:e].tobytes())
                # the first id in full, the differences in as many bytes as the largest takes
                d = step[s + 1 : e]
                width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(d) or d.max() < 1 << (8 * w))
                steps.append(step[s : s + 1].tobytes() + d.astype(f"<u{width}").tobytes())
            yield pa.record_batch([pa.array(part[at].astype(np.int32)), pa.array(keys, pa.binary()), pa.array(steps, pa.binary())], names=["part", "keys", "ids"])

    return run


def _unpack_one(keys: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(keys) // 5
    k = np.zeros((n, 8), dtype=np.uint8)
    k[:, :5] = np.frombuffer(keys, dtype=np.uint8).reshape(n, 5)
    step = np.empty(n, dtype=np.int64)
    step[0] = np.frombuffer(ids, dtype=np.int64, count=1)[0]
    if n > 1:
        step[1:] = np.frombuffer(ids, dtype=f"<u{(len(ids) - 8) // (n - 1)}", offset=8)
    return k.view(np.int64).ravel(), np.cumsum(step)


def _unpacked(hold: int):
    """(key, id) rows of packed ones. A partition of up to `hold` rows leaves out those whose key stands alone; of a larger one,
    which isn't held, all go on to the sort that follows."""

    def out(key, ids):
        for at in range(0, len(key), 1 << 16):
            yield pa.record_batch([pa.array(key[at : at + (1 << 16)]), pa.array(ids[at : at + (1 << 16)])], names=["key", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n, over = 0, False
        for b in batches:
            for keys, ids in zip(b.column(1), b.column(2)):
                held.append(_unpack_one(keys.as_py(), ids.as_py()))
                n += len(held[-1][0])
                if over or n > hold:
                    over = True
                    for x in held:
                        yield from out(*x)
                    held = []
        if held:
            key, ids = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(key, kind="stable")
            key = key[by]
            same = key[1:] == key[:-1]
            again = np.append(False, same) | np.append(same, False)
            yield from out(key[again], ids[by[again]])

    return run


def _pairs(block: int):
    """Pairs of ids within runs of equal key of sorted rows; a run longer than block comes out as (id, null) rows.

    No more than one batch and an open run of `block` ids is held.
    """
    none = np.zeros(0, np.int64)

    def emit(a, b, k):
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.int64())], names=["a", "b", "key"])

    def alone(ids, key):
        return emit(ids, pa.nulls(len(ids), pa.int64()), np.full(len(ids), key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_ids, large = None, none, False
        for b in batches:
            if not b.num_rows:
                continue
            key, ids = np.asarray(b.column(0)), np.asarray(b.column(1))
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            end = np.append(begin[1:], len(key))
            first = int(key[0] == open_key)
            if first:
                open_ids = np.concatenate([open_ids, ids[: end[0]]])
            if first < len(begin) and len(open_ids) > 1 and not large and len(open_ids) <= block:
                i, j = np.triu_indices(len(open_ids), 1)
                yield emit(open_ids[i], open_ids[j], np.full(len(i), open_key))
                open_ids = none
            if len(open_ids) and (large or len(open_ids) > block):
                yield alone(open_ids, open_key)
                open_ids, large = none, True
            if first == len(begin):
                continue
            # whole runs inside the batch; the last stays open
            s, n = begin[first:-1], (end - begin)[first:-1]
            for k in np.flatnonzero(n > block):
                yield alone(ids[s[k] : s[k] + n[k]], key[s[k]])
            out = []
            for size in np.unique(n[(n > 1) & (n <= block)]):
                i, j = np.triu_indices(size, 1)
                g = s[n == size]
                out.append((ids[(g[:, None] + i).ravel()], ids[(g[:, None] + j).ravel()], key[np.repeat(g, len(i))]))
            if out:
                yield emit(*[np.concatenate(c) for c in zip(*out)])
            open_key, open_ids, large = key[begin[-1]], ids[begin[-1] :], False
            if len(open_ids) > block:
                yield alone(open_ids, open_key)
                open_ids, large = none, True
        if len(open_ids) > 1 and not large:
            i, j = np.triu_indices(len(open_ids), 1)
            yield emit(open_ids[i], open_ids[j], np.full(len(i), open_key))
        elif large and len(open_ids):
            yield alone(open_ids, open_key)

    return run


def bucket_pairs(src: DataFrame, n_rows: int, block: int = BLOCK, keyed=None, hold: int = HOLD) -> DataFrame:
    """Distinct (a, b), a < b, of ids that share a key. Every pair of a bucket is made, the larger buckets' in blocks
    that spread over the cluster: an id meets one block of its bucket per task.

    src has (key, id) rows, or rows that `keyed` turns into such batches, in the pass that packs them. n_rows, their number,
    sets the number of tasks. A sort that spills orders the rows of a task, however many share a key.
    """
    parts = min(max(shuffle_partitions(src.sparkSession), -(-n_rows // ROWS_PER_TASK)), 1 << 24)
    pack = _packed(parts)
    packed = src.mapInArrow((lambda batches: pack(keyed(batches))) if keyed else pack, "part int, keys binary, ids binary")
    rows = packed.repartitionById(parts, "part").mapInArrow(_unpacked(hold), "key bigint, id bigint")
    s = stash(rows.sortWithinPartitions("key").mapInArrow(_pairs(block), "a bigint, b bigint, key bigint"), "bucket-pairs")
    small = s.filter("b is not null").select("a", "b")
    big = s.filter("b is null").select("key", F.col("a").alias("id"))
    n = big.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    big = big.join(n, "key").withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = big.select("key", F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"))
    pairs = left.join(big.select("key", "at", F.col("id").alias("b")), ["key", "at"]).filter("a < b").select("a", "b")
    return small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").unionAll(pairs).distinct()


def _short_runs(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct row << 16 | value, how often, values of each row) of binary arrays of sorted 16-bit values."""
    a = a.cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    n = np.diff(off) // 2
    v = np.frombuffer(a.buffers()[2], dtype=np.uint16)[off[0] // 2 : off[-1] // 2] if len(n) and n.any() else np.zeros(0, np.uint16)
    k = (np.repeat(np.arange(len(n)), n) << 16) | v
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.diff(np.append(at, len(k))), n


def _likely(threshold: float):
    """Of (a, b, runs of a, runs of b) rows those that can be similar enough. Equal runs have equal low bits, so the values two
    records have in common are at least as many as their common runs: no pair is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ka, ca, na = _short_runs(b.column(2))
            kb, cb, nb = _short_runs(b.column(3))
            at = np.minimum(np.searchsorted(kb, ka), max(0, len(kb) - 1))
            hit = kb[at] == ka if len(kb) else np.zeros(len(ka), dtype=bool)
            both = np.bincount(ka[hit] >> 16, weights=np.minimum(ca[hit], cb[at[hit]]), minlength=b.num_rows)
            ok = both * (1 + threshold) >= threshold * (na + nb) - 1e-6
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return run


def _check(size: int, min_tokens: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            r, x = batch_shingles(pa.concat_arrays([b.column(2).cast(pa.large_string()), b.column(3).cast(pa.large_string())]), size, min_tokens)
            counts = np.bincount(r, minlength=2 * n)
            by = np.lexsort((x, r % n)) if n else np.zeros(0, np.int64)
            p, y = (r % n)[by] if n else r, x[by]
            both = np.bincount(p[1:][(p[1:] == p[:-1]) & (y[1:] == y[:-1])], minlength=n)
            either = counts[:n] + counts[n:] - both
            j = np.divide(both, either, out=np.zeros(n), where=either > 0)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(j)], names=["a", "b", "similarity"]).filter(pa.array(j >= threshold))

    return run


def _identified(records: DataFrame, id: str, text: str, size: int, min_tokens: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records with text, the hashes of those long enough, and the classes of equal sets of runs."""
    src = records.filter(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    ident = stash(src.mapInArrow(_identify(size, min_tokens), "id bigint, h1 bigint, h2 bigint, t1 bigint, t2 bigint, runs binary"), "identified")
    classes = ident.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep < last").select("h1", "h2", "rep")
    members = stash(ident.select("id", "h1", "h2", "t1", "t2").join(classes, ["h1", "h2"]).select("id", "rep", "t1", "t2").distinct(), "class-members")
    return src, ident, members


def record_copies(records: DataFrame, id: str = "review_id", text: str = "text", size: int = SHINGLE, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(id, copy_of): every record of at least min_tokens tokens whose exact text another has too, with the first of them."""
    members = _identified(records, id, text, size, min_tokens)[2]
    g = members.groupBy("rep", "t1", "t2").agg(F.min("id").alias("copy_of"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return members.join(g, ["rep", "t1", "t2"]).select("id", "copy_of")


def similar_links(
    records: DataFrame,
    id: str = "review_id",
    text: str = "text",
    size: int = SHINGLE,
    min_tokens: int = MIN_TOKENS,
    threshold: float = THRESHOLD,
    coordinates: int = COORDINATES,
    bands: int = BANDS,
    rows: int = ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(links, members). links (a, b, similarity): representatives a < b of different sets of runs, similar to at least
    `threshold`. members (id, rep, t1, t2): the records that share their set of runs with others, by the smallest id of the
    class, and a 128-bit hash of each one's text, since a class may hold different texts.

    Repeated deliveries of an id (equal in their text) and equal sets of runs fall together before anything is banded: of
    each class only the representative is, and the hashes that say so are combined on the map side. Null, empty and shorter
    texts have no part in it; an empty table gives empty tables. Candidates agree in `rows` coordinates of one of `bands` bands;
    those that 16 bits of each run don't rule out are compared exactly. No text is written or moved but those compared.
    """
    src, ident, members = _identified(records, id, text, size, min_tokens)
    copies = members.filter("id <> rep").select("id")
    first = src.join(copies, "id", "left_anti")
    n = ident.select("id").count() - copies.count()
    cands = bucket_pairs(first, n * bands, keyed=_bands(size, min_tokens, coordinates, band_layout(coordinates, bands, rows)))
    runs = ident.select("id", "runs").join(copies, "id", "left_anti")
    near = cands.join(runs.select(F.col("id").alias("a"), F.col("runs").alias("ra")), "a").join(runs.select(F.col("id").alias("b"), F.col("runs").alias("rb")), "b")
    near = stash(near.select("a", "b", "ra", "rb").mapInArrow(_likely(threshold), "a bigint, b bigint"), "likely-pairs")
    need = near.select(F.col("a").alias("id")).unionAll(near.select(F.col("b").alias("id"))).distinct()
    texts = stash(first.join(need, "id", "left_semi"), "compared-texts")
    with_a = near.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    links = with_b.select("a", "b", "ta", "tb").mapInArrow(_check(size, min_tokens, threshold), "a bigint, b bigint, similarity double")
    # a second delivery of a record gives its pairs again
    return links.distinct(), members


def similar_pairs(links: DataFrame, members: DataFrame, expand: int = EXPAND, block: int = BLOCK) -> DataFrame:
    """(a, b) of all records, a < b: the different texts of a class with each other, and links carried over to every text of
    both classes, in blocks over the cluster.

    More than `expand` exact copies of a text are not written out as pairs: they link to the first of them, which stands
    for them in pairs with other texts.
    """
    texts = stash(members.groupBy("rep", "t1", "t2").agg(F.min("id").alias("text_id"), F.count(F.lit(1)).alias("n")), "class-texts")
    copies = members.join(texts.filter("n > 1"), ["rep", "t1", "t2"])
    small = copies.filter(F.col("n") <= expand).select("text_id", "id")
    within = small.join(small.select("text_id", F.col("id").alias("b")), "text_id").filter("id < b").select(F.col("id").alias("a"), "b")
    star = copies.filter((F.col("n") > expand) & (F.col("id") != F.col("text_id"))).select(F.col("text_id").alias("a"), F.col("id").alias("b"))
    blocks = texts.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    of = texts.join(blocks, "rep").withColumn("k", F.pmod(F.xxhash64("text_id"), F.col("blocks")).cast("int")).select("rep", "k", "text_id", "blocks")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("k")
    between = of.select("rep", F.col("text_id").alias("a"), every).join(of.select("rep", "k", F.col("text_id").alias("b")), ["rep", "k"]).filter("a < b").select("a", "b")
    cross = links.select("a", "b")
    for c, other in (("a", "b"), ("b", "a")):
        cross = cross.join(blocks.withColumnRenamed("rep", c), c, "left").select(c, other, every)
        cross = cross.join(of.select(F.col("rep").alias(c), "k", F.col("text_id").alias(f"_{c}")), [c, "k"], "left").select(F.coalesce(f"_{c}", c).alias(c), other)
    cross = between.unionAll(cross.select("a", "b"))
    for c in ("a", "b"):
        side = small.select(F.col("text_id").alias(c), F.col("id").alias(f"_{c}"))
        cross = cross.join(side, c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return within.unionAll(star).unionAll(cross)


def components(links: DataFrame) -> DataFrame:
    """(node, group): the smallest node each node is connected to, over links (a, b).

    Alternating large-star and small-star steps; every step's links are checkpointed, and only a count of changes
    reaches the driver.
    """
    e = cut(links.select("a", "b").filter("a <> b").distinct())
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        j = down.join(least, "a")
        small = j.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        new = cut(small.distinct())
        changed = new.exceptAll(e).limit(1).count() + e.exceptAll(new).limit(1).count()
        e = new
        if not changed:
            break
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("group"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("group")).unionAll(roots)


def duplicate_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group, n_links): the group of every record of a class with copies or links, and the number of links of its class."""
    sides = links.select("a").unionAll(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    comp = components(links)
    reps = members.select(F.col("rep").alias("node")).distinct().unionAll(comp.select("node")).distinct()
    per = reps.join(comp, "node", "left").join(sides.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("group", "node").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # a representative without copies is no member
    ids = members.select("id", "rep").unionAll(comp.select(F.col("node").alias("id"), F.col("node").alias("rep"))).distinct()
    return ids.join(per.withColumnRenamed("node", "rep"), "rep").select("id", "group", "n_links")
