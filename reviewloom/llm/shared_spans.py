"""Long verbatim spans shared between documents.

Units of every document are hashed, their digests grouped over the whole collection, and each group keeps its earliest
occurrence; the others are removed, or here linked to it, with their offsets in the original text.

Two kinds of units:

* `line` or `paragraph`: the text's own units, normalised (trimmed, runs of blanks as one, case folded);
* `window`: content-defined units for spans that begin and end in the middle of lines. Of the hashes of all runs of
  `unit` characters, the smallest in each stretch of `span - unit + 1` runs is a unit (winnowing). Two texts that share
  `span` characters share such a stretch and so select the same unit in it: none is missed. Windows are not
  normalised, since the spans are verbatim.

Units that meet in other documents propose (document, document, shift of offsets); an exact comparison along that shift
gives the spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.arrow_tokens import mix64
from reviewloom.operators.key_profile import hot_keys
from reviewloom.session import measured_stash, stash

SPAN = 200
UNIT = 100
#: Documents with the same unit are paired in one task up to this number, with so many places of it each on average.
EXPAND = 64
PLACES = 2
#: More places than this of one digest don't go to one task.
HOT = 1 << 25
#: Larger groups are paired in blocks of so many documents.
BLOCK = 256

SEPARATORS = {"line": "\n", "paragraph": "\n\n"}

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: In place of a null.
_NOBODY = -(1 << 63)
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int, name: str, base: int) -> np.ndarray:
    t = _powers.get(name)
    if t is None or len(t) < n:
        t = np.full(max(n, 1 << 16), base, dtype=_U64)
        t[0] = 1
        t = np.multiply.accumulate(t)
        _powers[name] = t
    return t[:n]


def window_hashes(codes: np.ndarray, unit: int) -> np.ndarray:
    """64-bit hash of each run of `unit` code points; equal runs have equal hashes wherever they stand."""
    n = len(codes)
    if n < unit:
        return np.zeros(0, dtype=_U64)
    s = np.zeros(n + 1, dtype=_U64)
    np.cumsum(mix64(codes.astype(_U64) + _U64(1)) * _power_table(n, "up", _BASE), out=s[1:])
    return mix64((s[unit:] - s[:-unit]) * _power_table(n - unit + 1, "down", _INVERSE))


_PLACE = (1 << 28) - 1


def winnow(h: np.ndarray, stretch: int) -> np.ndarray:
    """Positions of the first smallest hash of each stretch of that many; with fewer hashes, of them all."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    stretch = min(stretch, n)
    # the position breaks ties, and comes out of the minimum again
    m = -(-n // stretch) * stretch
    p = np.full(m, _MASK, dtype=_U64)
    p[:n] = (h & ~_U64(_PLACE)) | (np.arange(n, dtype=_U64) & _U64(_PLACE))
    # minimum of every stretch from prefix and suffix minima of blocks
    blocks = p.reshape(-1, stretch)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - stretch + 1], fore[stretch - 1 : n])
    at = (least[np.concatenate([[True], least[1:] != least[:-1]])] & _U64(_PLACE)).astype(np.int64)
    return at if n <= _PLACE else np.unique(np.concatenate([k + winnow(h[k : k + _PLACE], stretch) for k in range(0, n, _PLACE - stretch)]))


def thin_chains(at: np.ndarray, digest: np.ndarray, unit: int, step: int) -> np.ndarray:
    """Mask without most of the inner places of chains: equal units that overlap make a periodic stretch.

    Aligning the first or the last unit of one finds whatever spans it shares with its surroundings, and one unit every
    `step` places covers the stretch itself.
    """
    by = np.lexsort((at, digest))
    a, d = at[by], digest[by]
    near = np.zeros(len(a), dtype=bool)
    near[1:] = (d[1:] == d[:-1]) & (a[1:] - a[:-1] < unit)
    if not near.any():
        return np.ones(len(at), dtype=bool)
    head = np.maximum.accumulate(np.where(near, 0, np.arange(len(a))))
    bucket = (a - a[head]) // max(1, step)
    last = ~np.append(near[1:], False)
    keep = np.zeros(len(at), dtype=bool)
    keep[by] = ~near | last | (bucket != np.append(-1, bucket[:-1]))
    return keep


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _digest(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _window_units(unit: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, digests = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is None or len(t) < span:
                    continue
                h = window_hashes(_codes(t), unit)
                p = winnow(h, span - unit + 1)
                p = p[thin_chains(p, h[p], unit, span - unit)]
                ids.append(np.full(len(p), i, dtype=np.int64))
                at.append(p)
                digests.append(h[p])
            if ids:
                yield pa.record_batch([pa.array(np.concatenate(ids)), pa.array(np.concatenate(at).astype(np.int32)), _digest(np.concatenate(digests))], names=["id", "at", "digest"])

    return run


def text_units(docs: DataFrame, kind: str = "window", unit: int = UNIT, span: int = SPAN) -> DataFrame:
    """(id, at, digest) of the windows, or (id, at, 128-bit digest, text, number) of the lines or paragraphs of (id, text) rows.

    `at` is the offset in code points. Blank units are left out.
    """
    if kind == "window":
        if not 0 < unit <= span:
            raise ValueError("a unit is at most as long as a span")
        return docs.mapInArrow(_window_units(unit, span), "id bigint, at int, digest bigint")

    return docs.select("id", "text").mapInArrow(_text_units(SEPARATORS[kind]), "id bigint, at int, digest binary, text string, number int")


def _units(text: str, sep: str) -> Iterator[tuple[int, str]]:
    at = 0
    for u in text.split(sep):
        yield at, u
        at += len(u) + len(sep)


def _text_units(sep: str):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (i, at, xxhash.xxh3_128_digest(" ".join(u.split()).lower()), u, k)
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                if t is not None
                for k, (at, u) in enumerate(_units(t, sep))
                if u.strip()
            ]
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "at", "digest", "text", "number"])

    return run


def repeated_units(docs: DataFrame, kind: str = "paragraph") -> DataFrame:
    """(id, at, text, keep_id, keep_at, number): every unit that stands elsewhere before, with the occurrence that is kept.

    The earliest occurrence, by id and offset, is a map-side combined minimum per digest: a unit in every document moves
    one row per task, and joining it back is split by AQE where one digest is very common.
    """
    u = text_units(docs, kind)
    first = u.groupBy("digest").agg(F.min(F.struct("id", "at")).alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    j = u.join(first.select("digest", "keep"), "digest").filter((F.col("keep.id") != F.col("id")) | (F.col("keep.at") != F.col("at")))
    return j.select("id", "at", "text", F.col("keep.id").alias("keep_id"), F.col("keep.at").alias("keep_at"), "number")


def without_repeats(docs: DataFrame, kind: str = "paragraph") -> DataFrame:
    """(id, text, kept) of (id, text) rows: the text without its repeated units, and for each unit that stays its offset in
    the original text and its length. Null text stays null; ids must be unique."""
    gone = repeated_units(docs, kind).groupBy("id").agg(F.collect_set("number").alias("gone"))
    j = docs.select("id", "text").join(gone, "id", "left")
    return j.select("id", "text", "gone").mapInArrow(_remove(SEPARATORS[kind]), "id bigint, text string, kept array<struct<at:int,chars:int>>")


def _remove(sep: str):
    kept_type = pa.list_(pa.struct([("at", pa.int32()), ("chars", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, kept = [], []
            for t, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if t is None:
                    texts.append(None)
                    kept.append(None)
                    continue
                gone = set(gone or ())
                stay = [x for k, x in enumerate(_units(t, sep)) if k not in gone]
                texts.append(sep.join(u for _, u in stay))
                kept.append([{"at": at, "chars": len(u)} for at, u in stay])
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string()), pa.array(kept, kept_type)], names=["id", "text", "kept"])

    return run


def _link(expand: int, star: bool):
    """(a, b, at_a, at_b) links of sorted (digest, id, at) rows: all pairs of a group of up to `expand` documents.

    Of a larger group either each row is linked to the earliest, and each further place of the earliest document to one
    place in another (star), or all rows come out alone, with b null, the
    digest, and in at_b how far at_a is from the group's first place. Holds at most PLACES x `expand` rows.
    """

    def out(parts):
        cols = [np.concatenate(c) for c in zip(*parts)]
        alone = np.zeros(len(cols[1]), dtype=bool) if star else cols[1] == _NOBODY
        of = pa.array(cols[4], mask=~alone)
        return pa.record_batch([pa.array(cols[0]), pa.array(cols[1], mask=alone), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), of], names=["a", "b", "at_a", "at_b", "digest"])

    def pairs(ids, at):
        i, j = np.triu_indices(len(ids), 1)
        i, j = i[ids[i] != ids[j]], j[ids[i] != ids[j]]
        return ids[i], ids[j], at[i], at[j], np.zeros(len(i), dtype=np.int64)

    def more(first, ids, at, digest):
        if star:
            other = ids != first[0]
            ids, at = ids[other], at[other]
            return np.full(len(ids), first[0]), ids, np.full(len(ids), first[1]), at, np.full(len(ids), digest)
        return ids, np.full(len(ids), _NOBODY), at, at - first[1], np.full(len(ids), digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, ids, at, large = None, np.zeros(0, np.int64), np.zeros(0, np.int64), False
        parts: list = []

        def grow(new_ids, new_at):
            nonlocal ids, at, large
            if star and large and len(ids) > 1:
                # places of the first document that wait for another document
                new_ids, new_at, ids, at = np.concatenate([ids, new_ids]), np.concatenate([at, new_at]), ids[:0], at[:0]
                large = False
            if large:
                parts.append(more((ids[0], at[0]), new_ids, new_at, digest))
                return
            ids, at = np.concatenate([ids, new_ids]), np.concatenate([at, new_at])
            if len(ids) > PLACES * expand or 1 + np.count_nonzero(ids[1:] != ids[:-1]) > expand:
                large = True
                if star:
                    other = np.flatnonzero(ids != ids[0])
                    if not len(other):
                        return
                    k = other[0]
                    parts.append((ids[1:k], np.full(k - 1, ids[k]), at[1:k], np.full(k - 1, at[k]), np.full(k - 1, digest)))
                parts.append(more((ids[0], at[0]), ids, at, digest))
                ids, at = ids[:1], at[:1]

        def close():
            if not large and len(ids) > 1:
                parts.append(pairs(ids, at))

        for b in batches:
            if not b.num_rows:
                continue
            d, i, p = (np.asarray(b.column(c)).astype(np.int64) for c in range(3))
            begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            end = np.append(begin[1:], len(d))
            for k in np.unique(np.concatenate([[0], np.flatnonzero(end - begin > 1), [len(begin) - 1]])).tolist():
                s, e = begin[k], end[k]
                if d[s] != digest:
                    close()
                    digest, ids, at, large = d[s], i[s:s], p[s:s], False
                grow(i[s:e], p[s:e])
            parts = [x for x in parts if len(x[0])]
            if parts:
                yield out(parts)
                parts = []
        close()
        parts = [x for x in parts if len(x[0])]
        if parts:
            yield out(parts)

    return run


def _shifts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, shift): the different shifts between the places of (a, b, places of a, places of b) rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            rows = batch.slice(at, 1024)
            each = []
            for x, y in zip(rows.column(2), rows.column(3)):
                x, y = (np.asarray(v.values).astype(np.int64) for v in (x, y))
                if len(x) == 1 or len(y) == 1:
                    each.append(np.unique(y[:, None] - x).ravel())
                    continue
                # marked one place of a at a time: no more is held than the texts are long
                low = y.min() - x.max()
                seen = np.zeros(y.max() - x.min() - low + 1, dtype=bool)
                for p in x:
                    seen[y - p - low] = True
                each.append(np.flatnonzero(seen) + low)
            n = [len(v) for v in each]
            a, b = (pa.array(np.repeat(np.asarray(rows.column(c)), n)) for c in range(2))
            yield pa.record_batch([a, b, pa.array(np.concatenate(each).astype(np.int32))], names=["a", "b", "shift"])


def _block_shifts(large: DataFrame, block: int) -> DataFrame:
    """(a, b, shift), a < b: every pair of documents of each group of (digest, id, at, rel) rows, with all shifts of its run.

    rel is `at` less the group's first place. Runs that lie beside each other in the same places propose the same, so of
    groups with equal (id, rel) rows one stays. A document meets one block of its group per task.
    """
    row = [F.col("id"), F.col("rel")]
    same = [F.bit_xor(F.xxhash64(*row)).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), *row)).alias("s2"), F.count(F.lit(1)).alias("s3")]
    keep = large.groupBy("digest").agg(*same).groupBy("s1", "s2", "s3").agg(F.min("digest").alias("digest"))
    g = stash(large.join(keep.select("digest"), "digest", "left_semi").groupBy("digest", "id").agg(F.collect_list("at").alias("places")), "span-groups")
    n = g.groupBy("digest").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    g = g.join(n, "digest").withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = g.select("digest", F.col("id").alias("a"), F.col("places").alias("pa"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    pairs = left.join(g.select("digest", "k", F.col("id").alias("b"), F.col("places").alias("pb")), ["digest", "k"]).filter("a < b")
    return pairs.select("a", "b", "pa", "pb").mapInArrow(_shifts, "a bigint, b bigint, shift int")


def _around(unit: int, span: int):
    """(digest, id, at) of every run of `span` code points that holds the unit at a given place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, places, t in zip(*(b.column(c).to_pylist() for c in range(3))):
                h = window_hashes(_codes(t), span)
                at = np.unique(np.concatenate([np.arange(max(0, p + unit - span), min(p, len(h) - 1) + 1) for p in places]))
                at = at[thin_chains(at, h[at], span, unit)]
                yield pa.record_batch([_digest(h[at]), pa.array(np.full(len(at), i, dtype=np.int64)), pa.array(at.astype(np.int32))], names=["digest", "id", "at"])

    return run


def _links(units: DataFrame, name: str, expand: int, star: bool, hot: int) -> DataFrame:
    """(a, b, at_a, at_b, digest) links of (digest, id, at) rows, as _link makes them.

    A digest with more than `hot` places, of which there are fewer than places / hot, is found by exact selection, and its
    places never meet in a task: its earliest occurrence is a minimum combined on the map side.
    """
    u, seen = measured_stash(units.select("digest", "id", "at"), name, F.count(F.lit(1)).alias("n"))
    schema = "a bigint, b bigint, at_a int, at_b int, digest bigint"
    link = lambda rows: rows.repartition("digest").sortWithinPartitions("digest", "id", "at").mapInArrow(_link(expand, star), schema)
    if seen["n"] <= hot:
        return link(u)
    keys = stash(hot_keys(u.select(F.col("digest").alias("key"), F.lit(1).alias("weight")), -(-seen["n"] // hot), bins=64).select(F.col("key").alias("digest")), "hot-digests")
    h = u.join(F.broadcast(keys), "digest")
    first = h.groupBy("digest").agg(F.min(F.struct("id", "at")).alias("f"))
    h = h.join(F.broadcast(first), "digest")
    if not star:
        alone = h.select(F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col("at").alias("at_a"), (F.col("at") - F.col("f.at")).alias("at_b"), "digest")
        return link(u.join(F.broadcast(keys), "digest", "left_anti")).unionByName(alone)
    other = h.filter("id <> f.id").groupBy("digest").agg(F.min(F.struct("id", "at")).alias("o"))
    h = h.join(F.broadcast(other), "digest").filter("id <> f.id or at <> f.at")
    own = F.col("id") == F.col("f.id")
    to_first = h.select(
        F.col("f.id").alias("a"), F.when(own, F.col("o.id")).otherwise(F.col("id")).alias("b"), F.when(own, F.col("at")).otherwise(F.col("f.at")).alias("at_a"), F.when(own, F.col("o.at")).otherwise(F.col("at")).alias("at_b"), "digest"
    )
    return link(u.join(F.broadcast(keys), "digest", "left_anti")).unionByName(to_first)


def _compare(span: int, one: bool):
    """Maximal equal stretches of at least `span` along a shift, of (a, b, shifts, ta, tb) rows: all, or one shift's at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("at_a", pa.int32()), ("at_b", pa.int32()), ("chars", pa.int32())])
        for batch in batches:
            rows = []
            for a, b, shifts, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(5))):
                x, y = _codes(ta), _codes(tb)
                for shift in sorted(set(shifts)):  # at_b - at_a
                    lo, hi = max(0, -shift), min(len(x), len(y) - shift)
                    if hi - lo < span:
                        continue
                    eq = np.zeros(hi - lo + 2, dtype=np.int8)
                    eq[1:-1] = x[lo:hi] == y[lo + shift : hi + shift]
                    edge = np.diff(eq)
                    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    spans = [(a, b, lo + int(i), lo + int(i) + shift, int(j - i)) for i, j in zip(s, e) if j - i >= span]
                    rows += spans
                    if one and spans:
                        break
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def shared_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", span: int = SPAN, unit: int = UNIT, expand: int = EXPAND, every: bool = True, block: int = BLOCK, one: bool = False, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(spans, members). spans (a, b, at_a, at_b, chars): maximal verbatim spans of at least `span` code points that
    documents a < b share. members (id, rep): documents with exactly the same text, by the smallest id.

    Exact copies fall together first (combined on the map side), so spans hold representatives only. A unit found in
    more than `expand` documents proposes nothing itself: all runs of `span` characters around its places are grouped in its
    stead, so that a common unit costs no comparison unless a whole span around it is shared. Where such a run, and so a
    true span, stands in more than `expand` documents too, or in PLACES x `expand` places of any number of them, they are paired each with each in blocks over the cluster.
    Without `every` they are linked to the earliest one only, which finds fewer pairs. With `one`, a pair gives the spans of one
    shift, as where it only matters which documents share any. Null texts, texts shorter than `span` and rows without an id have no part in it; an empty table gives
    empty tables. Ids must be unique.
    """
    d = docs.filter(F.col(id).isNotNull() & (F.length(text) >= span)).select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    members = stash(document_copies(docs, id, text, span), "text-classes")
    copies = members.filter("id <> rep").select("id")
    reps = d.join(copies, "id", "left_anti")
    links = stash(_links(reps.mapInArrow(_window_units(unit, span), "id bigint, at int, digest bigint"), "units", expand, False, hot), "unit-links")
    # the places of common units, looked at again in all runs of `span` characters around them
    common = links.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.collect_set("at_a").alias("places"))
    wide = common.join(reps, "id").select("id", "places", "text").mapInArrow(_around(unit, span), "digest bigint, id bigint, at int")
    around = stash(_links(wide, "runs", expand, not every, hot), "run-links")
    moved = links.unionAll(around).filter("b is not null").select("a", "b", (F.col("at_b") - F.col("at_a")).alias("shift"))
    if every:
        moved = moved.unionAll(_block_shifts(around.filter("b is null").select("digest", F.col("a").alias("id"), F.col("at_a").alias("at"), F.col("at_b").alias("rel")), block))
    shifts = stash(moved.groupBy("a", "b").agg(F.collect_set("shift").alias("shifts")), "span-links")
    need = shifts.select(F.col("a").alias("id")).unionAll(shifts.select(F.col("b").alias("id"))).distinct()
    texts = stash(d.join(need, "id", "left_semi"), "span-texts")
    # b first: where a is the earliest of very many, each other text moves once and the join by a can be split
    j = shifts.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    spans = j.select("a", "b", "shifts", "ta", "tb").mapInArrow(_compare(span, one), "a bigint, b bigint, at_a int, at_b int, chars int")
    return spans, members


def document_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(id, rep): every document of at least `span` code points whose exact text another has too, with the first of them."""
    d = docs.filter(F.col(id).isNotNull() & (F.length(text) >= span))
    return _classes(d.select(F.col(id).cast("bigint").alias("id"), F.xxhash64(text).alias("h1"), F.hash(F.reverse(text)).alias("h2")))


def _classes(hashed: DataFrame) -> DataFrame:
    """(id, rep) of rows (id, h1, h2) that are not alone with their hashes."""
    g = hashed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return hashed.join(g.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep")


def span_pairs(spans: DataFrame, members: DataFrame, expand: int = EXPAND) -> DataFrame:
    """(a, b) of all documents, a < b, that share a span. Copies of a text are written out up to `expand` of them; a larger
    class links to its first member, which stands for it."""
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    m = members.join(sizes, "rep")
    small = m.filter(F.col("n") <= expand).select("rep", "id")
    within = small.join(small.select("rep", F.col("id").alias("b")), "rep").filter("id < b").select(F.col("id").alias("a"), "b")
    star = m.filter((F.col("n") > expand) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    cross = spans.select("a", "b").distinct()
    for c in ("a", "b"):
        cross = cross.join(small.select(F.col("rep").alias(c), F.col("id").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return within.unionAll(star).unionAll(cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def shared_characters(docs: DataFrame, spans: DataFrame, members: DataFrame, id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(id, n_chars, shared_chars): for every document, how many of its code points stand in a span of another document.

    A copy shares all of its text. Overlapping spans of a document count once: spans are merged in order of their
    offsets. A null text has null lengths.
    """
    s = spans.select(F.col("a").alias("id"), F.col("at_a").alias("s"), (F.col("at_a") + F.col("chars")).alias("e")).unionAll(
        spans.select(F.col("b").alias("id"), F.col("at_b").alias("s"), (F.col("at_b") + F.col("chars")).alias("e"))
    )
    w = Window.partitionBy("id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    s = s.distinct().withColumn("before", F.coalesce(F.max("e").over(w), F.lit(0)))
    n = s.groupBy("id").agg(F.sum(F.greatest(F.col("e") - F.greatest("s", "before"), F.lit(0))).cast("bigint").alias("shared"))
    c = members.select("id", F.lit(True).alias("copy"))
    d = docs.select(F.col(id).alias("id"), F.length(text).cast("bigint").alias("n_chars"))
    j = d.join(n, "id", "left").join(c, "id", "left")
    got = F.when(F.col("n_chars").isNull(), F.lit(None)).when(F.col("copy"), F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0)))
    return j.select(F.col("id").alias(id), "n_chars", got.cast("bigint").alias("shared_chars"))
