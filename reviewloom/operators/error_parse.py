"""Minimum-cost parse of raw records: valid rows load with their types, the others come with reasons and edits.

A csv record is read as a sequence of quotes, commas and literal runs. A shortest-path dynamic program over
(position, state of the quoting automaton, fields so far) may insert or delete a quote or a comma at cost 1. A
record that parses at cost 0 and whose values are valid loads; otherwise the cheapest edits say what is wrong with it:

* `quoting`: without regard to the number of fields, the cheapest parse costs more than 0;
* `columns`: the quotes are sound, but reaching the wanted number of fields costs more than 0;
* `helpfulness`, `score`, `text`: a value is invalid (each that applies).

A dump record is a sequence of field openings; its cheapest repair inserts each missing field and deletes each
repeated one. Null or unknown input is a record without fields: reason `columns`. Literal runs count as one symbol, so
the program's size depends on the number of quotes and commas, not on the length of the text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the record layout
CSV_FIELDS = ("product_id", "helpfulness", "score", "text")
DUMP_FIELDS = {"product/productId": "product_id", "review/helpfulness": "helpfulness", "review/score": "score", "review/text": "text"}

_SYMBOL = re.compile(r'"|,|[^",]+')
_OPEN = re.compile(r"(?:product|review)/\w+: ")
_HELP = re.compile(r"([0-9]+)/([0-9]+)")
_SCORE = re.compile(r"[0-9]+(?:\.[0-9]+)?")
_BAD_TEXT = re.compile(r"[\x00-\x08\x0b-\x1f\x7f\ufffd]")
_FIELD = r'(?:"((?:[^"]|"")*)"|([^",][^,]*)|)'
_STRICT = re.compile(",".join([_FIELD] * len(CSV_FIELDS)))

_START, _BARE, _QUOTED, _CLOSED = range(4)
#: state, symbol -> (next state, fields added); what is missing is impossible at cost 0
_STEP = {
    (_START, "q"): (_QUOTED, 0),
    (_START, "c"): (_START, 1),
    (_START, "x"): (_BARE, 0),
    (_BARE, "q"): (_BARE, 0),
    (_BARE, "c"): (_START, 1),
    (_BARE, "x"): (_BARE, 0),
    (_QUOTED, "q"): (_CLOSED, 0),
    (_QUOTED, "c"): (_QUOTED, 0),
    (_QUOTED, "x"): (_QUOTED, 0),
    (_CLOSED, "q"): (_QUOTED, 0),
    (_CLOSED, "c"): (_START, 1),
}
_NAME = {"q": "quote", "c": "comma"}


def cheapest_edits(raw: str, fields: int | None) -> list[str]:
    """Edits of the cheapest parse into `fields` fields (None: any number), as `insert|delete quote|comma @offset`.

    Empty if the record parses as it is. Of equally cheap repairs always the same one is given.
    """
    symbols, at = [], []
    for m in _SYMBOL.finditer(raw):
        symbols.append({'"': "q", ",": "c"}.get(m[0], "x"))
        at.append(m.start())
    at.append(len(raw))
    n, most = len(symbols), fields or 1
    count = (lambda f, d: min(f + d, most + 1)) if fields else (lambda f, d: 1)
    heap: list[tuple] = [(0, 0, 0, _START, 1)]
    best = {(0, _START, 1): (0, None, "")}
    order = 0
    while heap:
        cost, _, i, state, f = heapq.heappop(heap)
        if best[i, state, f][0] < cost:
            continue
        if i == n and state != _QUOTED and (not fields or f == fields):
            edits, node = [], (i, state, f)
            while node is not None:
                _, node_before, edit = best[node]
                if edit:
                    edits.append(edit)
                node = node_before
            return edits[::-1]
        moves = []
        if i < n:
            if step := _STEP.get((state, symbols[i])):
                moves.append((0, i + 1, step[0], count(f, step[1]), ""))
            if symbols[i] != "x":
                moves.append((1, i + 1, state, f, f"delete {_NAME[symbols[i]]} @{at[i]}"))
        for s in "qc":
            step = _STEP[state, s]
            if (step[0], count(f, step[1])) != (state, f):
                moves.append((1, i, step[0], count(f, step[1]), f"insert {_NAME[s]} @{at[i]}"))
        for more, j, to, g, edit in moves:
            if fields and g > fields:
                continue
            key, c = (j, to, g), cost + more
            if key not in best or c < best[key][0]:
                best[key] = (c, (i, state, f), edit)
                order += 1
                heapq.heappush(heap, (c, order, j, to, g))
    return [f"insert comma @{len(raw)}"] * ((fields or 1) - 1)


def read_csv(raw: str) -> tuple[dict[str, str] | None, str | None, list[str]]:
    """(fields, None, []) of a sound record, else (None, reason, edits)."""
    if m := _STRICT.fullmatch(raw):
        g = m.groups()
        return {c: g[2 * i].replace('""', '"') if g[2 * i] is not None else g[2 * i + 1] or "" for i, c in enumerate(CSV_FIELDS)}, None, []
    if edits := cheapest_edits(raw, None):
        return None, "quoting", edits
    return None, "columns", cheapest_edits(raw, len(CSV_FIELDS))


def read_dump_record(raw: str) -> tuple[dict[str, str] | None, str | None, list[str]]:
    found: dict[str, list[str]] = {c: [] for c in DUMP_FIELDS.values()}
    current: list[str] | None = None
    values: list[tuple[str | None, list[str]]] = []
    for line in raw.split("\n"):
        if m := _OPEN.match(line):
            current = [line[m.end() :]]
            values.append((DUMP_FIELDS.get(m[0][:-2]), current))
        elif current is not None:
            current.append(line)
    for column, lines in values:
        if column:
            found[column].append("\n".join(lines))
    edits = [f"insert {c}" if not v else f"delete {c}" for c, v in found.items() for _ in range(abs(len(v) - 1))]
    if edits:
        return None, "columns", edits
    return {c: v[0] for c, v in found.items()}, None, []


def check_values(f: dict[str, str]) -> tuple[list[str], tuple[int, int] | None, float | None]:
    """(reasons, helpfulness, score)."""
    reasons, h, s = [], None, None
    m = _HELP.fullmatch(f["helpfulness"].strip(" \t\n"))
    if m and int(m[1]) <= int(m[2]):
        h = int(m[1]), int(m[2])
    else:
        reasons.append("helpfulness")
    score = f["score"].strip(" \t\n")
    if _SCORE.fullmatch(score) and 1 <= float(score) <= 5:
        s = float(score)
    else:
        reasons.append("score")
    if _BAD_TEXT.search(f["text"]):
        reasons.append("text")
    return reasons, h, s


_OUT = "id bigint, product_id string, helpfulness_num bigint, helpfulness_denom bigint, score double, text string, reasons array<string>, edits array<string>"
_ARROW = pa.schema(
    [
        ("id", pa.int64()),
        ("product_id", pa.string()),
        ("helpfulness_num", pa.int64()),
        ("helpfulness_denom", pa.int64()),
        ("score", pa.float64()),
        ("text", pa.string()),
        ("reasons", pa.list_(pa.string())),
        ("edits", pa.list_(pa.string())),
    ]
)
_LONG = 1 << 63


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, fmt, raw in zip(*(b.column(c).to_pylist() for c in ("id", "fmt", "raw"))):
            if raw is None or fmt not in ("csv", "dump"):
                fields, reason, edits = None, "columns", []
            else:
                fields, reason, edits = read_csv(raw) if fmt == "csv" else read_dump_record(raw)
            h = s = None
            if fields is None:
                reasons = [reason]
            else:
                reasons, h, s = check_values(fields)
                if h and max(h) >= _LONG:  # beyond bigint: no row can hold it
                    reasons, h = ["helpfulness", *[r for r in reasons if r != "helpfulness"]], None
            f = fields or {}
            rows.append((i, f.get("product_id"), h and h[0], h and h[1], s, f.get("text"), reasons, edits))
        cols = list(zip(*rows)) if rows else [[] for _ in _ARROW]
        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(cols, _ARROW)], schema=_ARROW)


def parse_raw(raw: DataFrame, id: str = "raw_id", fmt: str = "fmt", text: str = "raw") -> DataFrame:
    """(id, product_id, helpfulness_num, helpfulness_denom, score, text, reasons, edits): one row per raw record.

    `reasons` is empty for a row that loads; the typed columns of an invalid value are null. One narrow pass, no
    exchange. Other columns of the input are ignored, whatever their names. An empty table gives an empty table.
    """
    return raw.select(F.col(id).cast("bigint").alias("id"), F.col(fmt).alias("fmt"), F.col(text).alias("raw")).mapInArrow(_parse, _OUT)


def loaded(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.size("reasons") == 0).drop("reasons", "edits")


def rejected(parsed: DataFrame) -> DataFrame:
    """(id, reason, edits): one row per record and reason."""
    return parsed.filter(F.size("reasons") > 0).select("id", F.explode("reasons").alias("reason"), "edits")
