"""Inverted-index codecs as Spark columns: gamma, delta, bit packing, group varint, front coding.

Everything but bit-string decoding is a built-in expression. Values must be non-negative; null gives null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from reviewloom.operators.numbering import global_prefix


#: Bits decoded at a time.
BITS = 1 << 22
#: Cuts a string after every 8th or 2nd character in one linear pass.
_EVERY_8, _EVERY_2 = r"(?<=\G.{8})", r"(?<=\G.{2})"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gamma(n: Column | str) -> Column:
    """Unary length, then the binary digits of n+1 without the leading one."""
    b = F.bin(_col(n).cast("bigint") + 1)
    return F.concat(F.repeat(F.lit("1"), F.length(b) - 1), F.lit("0"), F.substr(b, F.lit(2)))


def delta(n: Column | str) -> Column:
    """Gamma code of the digit count less one, then the digits of n+1 without the leading one."""
    b = F.bin(_col(n).cast("bigint") + 1)
    return F.concat(gamma(F.length(b) - 1), F.substr(b, F.lit(2)))


def pack_bits(bits: Column | str) -> Column:
    """Bit string to bytes, right-padded with zeros; every byte is kept, leading zero bytes too."""
    b = _col(bits)
    n = F.ceil(F.length(b) / 8).cast("int")
    bytes_ = F.array_remove(F.split(F.rpad(b, n * 8, "0"), _EVERY_8), "")
    return F.unhex(F.array_join(F.transform(bytes_, lambda x: F.lpad(F.conv(x, 2, 16), 2, "0")), ""))


def unpack_bits(data: Column | str) -> Column:
    """Bytes to bit string, eight digits each."""
    pairs = F.array_remove(F.split(F.hex(_col(data)), _EVERY_2), "")
    return F.array_join(F.transform(pairs, lambda x: F.lpad(F.conv(x, 16, 2), 8, "0")), "")


def _window(bits: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The number in the `width` bits from each place; bits must be long enough."""
    v = np.zeros(len(at), dtype=np.int64)
    for k in range(width):
        v = (v << 1) | bits[at + k]
    return v


def decode_bits(bits: np.ndarray, row_ends: np.ndarray, most: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(row of each number, numbers) of the codes in rows of bits that lie one after the other; at most `most` a row.

    Where each code would end is worked out for all places at once, in a few passes over the bits; then a walk from code to
    code marks those that are there. Time and memory are in proportion to the bits.
    """
    n = len(bits)
    zero = np.flatnonzero(bits == 0)
    padded = np.concatenate([bits.astype(np.int64), np.zeros(72, dtype=np.int64)])
    place = np.arange(n)
    # the zero that ends the unary part begun at each place; n where there is none
    stop = np.append(zero, n)[np.searchsorted(zero, place)]
    unary = stop - place
    # digits after the leading one: as many as the unary part says, or in delta as many as the number that it begins says
    digits_at, digits = stop + 1, unary
    if kind == "delta":
        most_unary = np.minimum(unary, 6)  # lengths are below 64
        low = np.minimum(digits_at, n)
        digits = ((1 << most_unary) | (_window(padded, low, 6) >> (6 - most_unary))) - 1
        digits_at = digits_at + unary
    following = (digits_at + digits).tolist()
    starts: list[int] = []
    counts = np.zeros(len(row_ends), dtype=np.int64)
    begin = 0
    for r, (end, limit) in enumerate(zip(row_ends.tolist(), most.tolist())):
        at, k = begin, 0
        while at < end and k < limit:
            starts.append(at)
            at = following[at]
            k += 1
        if at > end:
            raise ValueError("a code ends before its last digit")
        counts[r] = k
        begin = end
    at = np.array(starts, dtype=np.int64)
    width = digits[at] if n else at
    values = np.zeros(len(at), dtype=np.int64)
    for w in np.unique(width):
        if w > 62:
            raise ValueError("a number of more than 62 digits")
        some = np.flatnonzero(width == w)
        values[some] = ((1 << int(w)) | _window(padded, digits_at[at[some]], int(w))) - 1
    return np.repeat(np.arange(len(row_ends)), counts), values


def _batch_bits(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bits, where each row ends) of strings of 0 and 1, or of bytes; nulls have none."""
    packed = pa.types.is_binary(data.type) or pa.types.is_large_binary(data.type)
    a = data.cast(pa.large_binary())
    a = a.fill_null(b"") if a.null_count else a
    off = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(a.buffers()[2], dtype=np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return (np.unpackbits(raw), (off[1:] - off[0]) * 8) if packed else (raw - ord("0"), off[1:] - off[0])


def _chunks(data: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about BITS bits, so that the arrays of a batch stay small."""
    bits, ends = _batch_bits(data)
    at = 0
    while at < len(ends):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BITS, side="right"))
        stop = max(stop, at + 1)
        yield at, stop
        at = stop


def _decoder(kind: str):
    def decode(data: pa.Array, count: pa.Array) -> pa.Array:
        most = np.asarray(count.cast(pa.int64()).fill_null(1 << 62))
        numbers, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in _chunks(data):
            row, values = decode_bits(*_batch_bits(data[s:e]), most[s:e], kind)
            numbers.append(values)
            sizes.append(np.bincount(row, minlength=e - s))
        offsets = np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int32)
        mask = np.append(np.asarray(data.is_null()), False) if data.null_count else None
        return pa.ListArray.from_arrays(pa.array(offsets, mask=mask), pa.array(np.concatenate(numbers)))

    return arrow_udf(decode, "array<bigint>")


def gamma_decode(data: Column | str, count: Column | str) -> Column:
    """Numbers of a gamma code, a string of bits or packed bytes; `count` cuts off those that padding bits would add (null: all)."""
    return _decoder("gamma")(data, count)


def delta_decode(data: Column | str, count: Column | str) -> Column:
    return _decoder("delta")(data, count)


def _whole_bytes(n: Column) -> Column:
    """Hex of n in the fewest whole bytes: leading zero bytes go, inner ones stay."""
    h = F.hex(n.cast("bigint"))
    return F.when(F.length(h) % 2 == 1, F.concat(F.lit("0"), h)).otherwise(h)


def group_varint(a, b, c, d) -> Column:
    """Four numbers below 2^32 as one header byte (two bits of length-1 each, first number highest) and their bytes."""
    parts = [_whole_bytes(_col(x)) for x in (a, b, c, d)]
    head = F.lit(0)
    for p in parts:
        head = head * 4 + (F.length(p) / 2 - 1).cast("int")
    return F.unhex(F.concat(F.lpad(F.hex(head.cast("bigint")), 2, "0"), *parts))


def group_varint_decode(data: Column | str) -> Column:
    """Struct v0..v3 of a group-varint value."""
    h = F.hex(_col(data))
    head = F.conv(F.substring(h, 1, 2), 16, 10).cast("int")
    at, out = F.lit(3), []
    for i in range(4):
        n = (F.shiftright(head, 6 - 2 * i).bitwiseAND(3) + 1) * 2
        out.append(F.conv(F.substring(h, at, n), 16, 10).cast("bigint").alias(f"v{i}"))
        at = at + n
    return F.struct(*out)


def review_row(product_num, helpfulness_num, helpfulness_denom, length, score) -> Column:
    """A stored review: its four numbers by group varint, then the score as one byte. Null numbers are stored as 0."""
    zero = lambda c: F.coalesce(_col(c).cast("bigint"), F.lit(0))
    four = group_varint(*[zero(c) for c in (product_num, helpfulness_num, helpfulness_denom, length)])
    return F.concat(four, F.unhex(F.lpad(F.hex(zero(score)), 2, "0")))


def review_row_decode(data: Column | str) -> Column:
    """Struct v0..v3 and score of a stored review."""
    d = _col(data)
    return F.struct(group_varint_decode(d).alias("v"), F.conv(F.right(F.hex(d), F.lit(2)), 16, 10).cast("int").alias("score"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix; 0 where either is null or empty."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.when(n > 0, F.coalesce(F.array_max(same), F.lit(0))).otherwise(F.lit(0)).cast("int")


def front_coding(dictionary: DataFrame, number: str = "token_num", word: str = "token", k: int = 8) -> DataFrame:
    """(token_num, block_offset, prefix_len, suffix, pointer) of a densely numbered dictionary.

    Block heads carry their pointer into the concatenated string and no prefix length; the others the reverse.
    Blocks never cross tasks, so any partitioning by block works.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    d = dictionary.select(number, word).withColumn("_block", F.expr(f"{number} div {k}")).withColumn("block_offset", (F.col(number) % k).cast("int"))
    prev = F.lag(word).over(Window.partitionBy("_block").orderBy(number))
    d = d.withColumn("_p", F.when(F.col("block_offset") == 0, F.lit(0)).otherwise(common_prefix(prev, F.col(word))))
    d = d.withColumn("suffix", F.substr(F.col(word), F.col("_p") + 1))
    d = global_prefix(d, [F.col(number)], {"_ptr": F.length("suffix")})
    head = F.col("block_offset") == 0
    return d.select(
        number,
        "block_offset",
        F.when(~head, F.col("_p")).alias("prefix_len"),
        "suffix",
        F.when(head, F.col("_ptr")).alias("pointer"),
    )


def front_decoding(coded: DataFrame, number: str = "token_num", word: str = "token", k: int = 8) -> DataFrame:
    """(token_num, token) from front-coded rows; a block's rows are at most k."""
    b = coded.groupBy(F.expr(f"{number} div {k}").alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.coalesce("prefix_len", F.lit(0)).alias("p"), F.col("suffix").alias("s")))).alias("r")
    )
    words = F.aggregate(
        "r",
        F.array().cast("array<struct<n:bigint,w:string>>"),
        lambda acc, x: F.concat(
            acc,
            F.array(
                F.struct(
                    x["n"].cast("bigint").alias("n"),
                    F.concat(F.when(x["p"] > 0, F.substring(F.element_at(acc, -1)["w"], F.lit(1), x["p"])).otherwise(F.lit("")), x["s"]).alias("w"),
                )
            ),
        ),
    )
    return b.select(F.explode(words).alias("e")).select(F.col("e.n").alias(number), F.col("e.w").alias(word))


def coded_segments(gaps: DataFrame) -> DataFrame:
    """(token, segment, n, data): the delta codes of gap, tf, gap, tf, … of each token's segment of n postings, packed.

    The first gap of a segment is the id itself, so a segment decodes alone.
    """
    from reviewloom.operators.build import segment

    codes = gaps.select("token", segment(F.col("review_id")).alias("segment"), "review_id", "gap", "tf")
    w = Window.partitionBy("token", "segment").orderBy("review_id")
    first = F.row_number().over(w) == 1
    codes = codes.withColumn("gap", F.when(first, F.col("review_id")).otherwise(F.col("gap")))
    codes = codes.withColumn("bits", F.concat(delta("gap"), delta("tf")))
    g = codes.groupBy("token", "segment").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("review_id", "bits"))).alias("c"))
    return g.select("token", "segment", "n", pack_bits(F.array_join(F.transform("c", lambda x: x["bits"]), "")).alias("data"))


def delta_coded_postings(gaps: DataFrame) -> DataFrame:
    """(token, segment, hex, n_bytes) of the coded segments."""
    h = F.hex("data")
    return coded_segments(gaps).select("token", "segment", h.alias("hex"), (F.length(h) / 2).cast("bigint").alias("n_bytes"))


def _decode_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        most = np.asarray(b.column(1)) * 2
        for s, e in _chunks(b.column(2)):
            row, v = decode_bits(*_batch_bits(b.column(2)[s:e]), most[s:e], "delta")
            row, gap, tf = row[::2], v[::2], v[1::2]
            total = np.cumsum(gap)
            first = np.searchsorted(row, row)
            ids = total - np.append(0, total)[first]
            yield pa.record_batch([b.column(0)[s:e].take(pa.array(row)), pa.array(ids), pa.array(tf)], names=["token", "review_id", "tf"])


def decoded_postings(segments: DataFrame) -> DataFrame:
    """(token, review_id, tf) from coded segments (token, segment, n, data), each decoded by itself: ids are the running sums of
    the gaps."""
    return segments.select("token", "n", "data").mapInArrow(_decode_segments, "token string, review_id bigint, tf bigint")
