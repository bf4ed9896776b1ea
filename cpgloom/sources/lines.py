"""Loading tab-separated lines, with the rows that do not parse set apart (problem 5).

Blocks of lines are parsed in bulk: one pass over their bytes finds the separators outside quotes, and
Arrow kernels cut and check the fields column by column, quoted ones as well. A block with a line of
broken quoting or of a wrong field count is rejected and halved again and again until the offending
lines stand alone; only those, and lines whose values fail the columnar check, see the strict line
parser, which names the first reason that applies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

QUOTING, COLUMN_COUNT, INVALID_VALUE, UNKNOWN_KIND = "quoting", "column_count", "invalid_value", "unknown_kind"

INT = r"^-?[0-9]+$"
NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class LineFormat:
    """Column names in file order, with the type of those that are checked and kept."""

    columns: tuple[str, ...]
    ints: tuple[str, ...]
    numbers: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    modification: str | None = None


SNIFFCELL = LineFormat(
    ("chrom", "start", "end", "source_row_start", "source_row_end"),
    ("start", "end", "source_row_start", "source_row_end"),
    texts=("chrom",),
)
METHBAT_COLUMNS = (
    "chrom", "start", "end", "name", "score", "strand", "mod_score", "type", "cov", "mod_count",
    "unmod_count", "inferred_unmod_count", "diff_base_count", "avg_mod_score", "avg_unmod_score",
)
#: Fixed: the file kinds and, for pileups, the modification code (m or h) they hold.
FORMATS = {
    "sniffcell_index": SNIFFCELL,
    "methbat_5mc": LineFormat(METHBAT_COLUMNS, ("start", "end", "cov"), ("mod_score",), ("chrom", "name", "strand", "type"), "m"),
    "methbat_5hmc": LineFormat(METHBAT_COLUMNS, ("start", "end", "cov"), ("mod_score",), ("chrom", "name", "strand", "type"), "h"),
}
TYPED = [
    ("chrom", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("source_row_start", pa.int64()),
    ("source_row_end", pa.int64()), ("name", pa.string()), ("strand", pa.string()), ("type", pa.string()),
    ("mod_score", pa.float64()), ("cov", pa.int64()),
]
STRANDS = {"m": (".",), "h": ("+", "-")}
TYPES = ("Total", "hap1", "hap2")


def split_strict(line: str) -> list[str] | None:
    """Fields of one line, or None if its quoting is broken. An empty line has no fields."""
    if line == "":
        return []
    if '"' not in line:
        return line.split("\t")
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"(?=\t|\Z)').match(line, i)
            if not m:
                return None
            fields.append(m.group(1).replace('""', '"'))
            i = m.end()
        else:
            j = line.find("\t", i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return None
            fields.append(line[i:j])
            i = j
        if i >= n:
            return fields
        i += 1  # the tab; a tab at the end leaves one more, empty field


def _int(s: str) -> int | None:
    if not re.fullmatch(r"-?[0-9]+", s):
        return None
    v = int(s) if len(s) < 400 else 1 << 64
    return v if -(1 << 63) <= v < 1 << 63 else None


def parse_strict(line: str, fmt: LineFormat) -> tuple[str | None, dict]:
    """(reason or None, typed values) of one line."""
    fields = split_strict(line)
    if fields is None:
        return QUOTING, {}
    if len(fields) != len(fmt.columns):
        return COLUMN_COUNT, {}
    raw = dict(zip(fmt.columns, fields))
    row: dict = {c: raw[c] for c in fmt.texts}
    for c in fmt.ints:
        row[c] = _int(raw[c])
        if row[c] is None:
            return INVALID_VALUE, {}
    for c in fmt.numbers:
        if not re.fullmatch(NUMBER[1:-1], raw[c]):
            return INVALID_VALUE, {}
        row[c] = float(raw[c])
    ok = row["chrom"] != "" and row["start"] >= 0
    if fmt.modification is None:
        ok = ok and row["start"] < row["end"] and 0 <= row["source_row_start"] < row["source_row_end"]
    else:
        ok = ok and row["end"] == row["start"] + 1 and 0 <= row["mod_score"] <= 100 and 1 <= row["cov"] <= 65534
        ok = ok and row["type"] in TYPES and row["name"] == fmt.modification
        ok = ok and row["strand"] in STRANDS[fmt.modification]
    return (None, row) if ok else (INVALID_VALUE, {})


TAB, QUOTE, UNIT = 9, 34, 31


def _structure(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """One columnar pass over the bytes of a block: the field count of every line (0 for an empty one),
    whether its quoting is regular, and the lines with each separating tab as a unit separator, so that
    tabs within quotes stay content. Lines that hold a unit separator themselves count as irregular."""
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = lines.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[lo:hi] if raw is not None and hi > lo else np.zeros(0, np.uint8)
    edges = offsets - lo
    tabs = np.flatnonzero(data == TAB)
    regular = np.ones(len(lines), bool)
    marks = np.flatnonzero(data == QUOTE)
    if len(marks):
        owner = np.searchsorted(edges, marks, "right") - 1
        inside = (np.arange(len(marks)) - np.searchsorted(marks, edges[owner])) % 2 == 1  # quotes of its line before it are odd
        first, last = marks == edges[owner], marks + 1 == edges[owner + 1]
        before, after = data[np.maximum(marks - 1, 0)], data[np.minimum(marks + 1, len(data) - 1)]
        follows = np.zeros(len(marks), bool)  # the quote just before is the first half of a doubled one
        follows[1:] = inside[:-1] & (marks[1:] == marks[:-1] + 1)
        opens = first | (before == TAB) | (follows & ~first)
        closes = last | (after == TAB) | (after == QUOTE)
        regular[owner[np.where(inside, ~closes, ~opens)]] = False
        total = np.searchsorted(marks, edges[1:]) - np.searchsorted(marks, edges[:-1])
        regular &= total % 2 == 0
        line = np.searchsorted(edges, tabs, "right") - 1
        tabs = tabs[(np.searchsorted(marks, tabs) - np.searchsorted(marks, edges[line])) % 2 == 0]
    units = np.flatnonzero(data == UNIT)
    regular[np.searchsorted(edges, units, "right") - 1] = False
    fields = np.searchsorted(tabs, edges[1:]) - np.searchsorted(tabs, edges[:-1]) + (edges[1:] > edges[:-1])
    split = data.copy()
    split[tabs] = UNIT
    return fields, regular, pa.StringArray.from_buffers(len(lines), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(split))


def _bisect(good: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Halve a rejected block until its offending lines stand alone: (lines of accepted blocks, offenders)."""
    bad_before = np.concatenate([[0], np.cumsum(~good)])
    accepted, alone, todo = [], [], [(0, len(good))] if len(good) else []
    while todo:
        lo, hi = todo.pop()
        if bad_before[hi] == bad_before[lo]:
            accepted.append(np.arange(lo, hi))
        elif hi - lo == 1:
            alone.append(lo)
        else:
            mid = (lo + hi) // 2
            todo += [(mid, hi), (lo, mid)]
    return (np.concatenate(accepted) if accepted else np.zeros(0, np.int64)), alone


def _columns(split: pa.Array, fmt: LineFormat) -> dict[str, pa.Array]:
    """The wanted columns of lines that all have the right number of fields, without enclosing quotes."""
    flat = pc.list_flatten(pc.split_pattern(split, chr(UNIT)))
    k, n = len(fmt.columns), len(split)
    at = {c: i for i, c in enumerate(fmt.columns)}
    quotes = bool(pc.any(pc.starts_with(flat, '"')).as_py())
    out = {}
    for c in (*fmt.texts, *fmt.ints, *fmt.numbers):
        x = flat.take(pa.array(np.arange(at[c], n * k, k)))
        if quotes:
            q = pc.starts_with(x, '"')
            if pc.any(q).as_py():
                x = pc.if_else(q, pc.replace_substring(pc.utf8_slice_codeunits(x, 1, -1), '""', '"'), x)
        out[c] = x
    return out


def _check(col: dict[str, pa.Array], fmt: LineFormat) -> tuple[pa.Array, dict[str, pa.Array]]:
    """Which rows are surely valid, and their typed columns (others hold nulls). Unusual but perhaps valid
    spellings (signs, more than 18 digits) are left to the strict parser."""
    ok = pc.not_equal(col["chrom"], "")
    out: dict[str, pa.Array] = {}
    null = pa.scalar(None, pa.string())
    for c in fmt.ints:
        good = pc.and_(pc.ascii_is_decimal(col[c]), pc.less_equal(pc.binary_length(col[c]), 18))
        out[c] = pc.cast(pc.if_else(good, col[c], null), pa.int64())
        ok = pc.and_(ok, good)
    for c in fmt.numbers:
        good = pc.match_substring_regex(col[c], NUMBER)
        out[c] = pc.cast(pc.utf8_ltrim(pc.if_else(good, col[c], null), "+"), pa.float64())
        ok = pc.and_(ok, good)
    if fmt.modification is None:
        for a, b in (("start", "end"), ("source_row_start", "source_row_end")):
            ok = pc.and_kleene(ok, pc.less(out[a], out[b]))
    else:
        ok = pc.and_kleene(ok, pc.equal(out["end"], pc.add(out["start"], 1)))
        for c, lo, hi in (("mod_score", 0.0, 100.0), ("cov", 1, 65534)):
            ok = pc.and_kleene(ok, pc.and_kleene(pc.greater_equal(out[c], lo), pc.less_equal(out[c], hi)))
        for c, allowed in (("type", TYPES), ("name", (fmt.modification,)), ("strand", STRANDS[fmt.modification])):
            ok = pc.and_kleene(ok, pc.is_in(col[c], pa.array(list(allowed))))
    for c in fmt.texts:
        out[c] = col[c]
    return pc.fill_null(ok, False), out


@dataclass
class Parsed:
    """A parsed block: valid lines of the fast path with their columns, and the lines parsed strictly."""

    valid: np.ndarray
    columns: dict[str, pa.Array]
    strict: list[int]
    outcomes: list[tuple[str | None, dict]]


def parse_block(lines: pa.Array | list[str], fmt: LineFormat, typed: bool = True) -> Parsed:
    """Parse a block in bulk, bisect it where it is rejected, and diagnose strictly the lines that stand
    alone and those whose values fail the columnar check."""
    lines = pa.array(lines, pa.string()) if isinstance(lines, list) else lines
    fields, regular, split = _structure(lines)
    taken, alone = _bisect(regular & (fields == len(fmt.columns)))
    columns: dict[str, pa.Array] = {}
    if len(taken):
        part = split if len(taken) == len(lines) else split.take(pa.array(taken))
        ok, columns = _check(_columns(part, fmt), fmt)
        ok = ok.to_numpy(zero_copy_only=False)
        if not ok.all():
            alone += taken[~ok].tolist()
            taken = taken[ok]
            columns = {c: a.filter(pa.array(ok)) for c, a in columns.items()} if typed else {}
    alone.sort()
    texts = lines.take(pa.array(alone, pa.int64())).to_pylist() if alone else []
    return Parsed(taken, columns if typed else {}, alone, [parse_strict(t, fmt) for t in texts])


def _parts(passed: list[str], batch: pa.RecordBatch, block: int, typed: bool):
    """(rows of the block as passed, reasons, typed columns) by file kind; without types only failures."""
    for at in range(0, batch.num_rows, block):
        part = batch.slice(at, block)
        kinds = part.column("kind__")
        for kind in pc.unique(kinds).to_pylist():
            fmt = FORMATS.get(kind)
            mine = pc.fill_null(pc.equal(kinds, kind), False) if kind is not None else pc.is_null(kinds)
            rows = part.filter(mine)
            keep = [rows.column(c) for c in passed]
            n = rows.num_rows
            if fmt is None:
                yield keep, pa.array([UNKNOWN_KIND] * n, pa.string()), {}, n
                continue
            lines = pc.fill_null(rows.column("text__"), "")
            lines = pc.replace_substring_regex(lines, "\r\\z", "") if pc.any(pc.ends_with(lines, "\r")).as_py() else lines
            p = parse_block(lines, fmt, typed)
            if typed and len(p.valid):
                at_rows = pa.array(p.valid)
                yield [c.take(at_rows) for c in keep], pa.nulls(len(p.valid), pa.string()), p.columns, len(p.valid)
            some = [i for i, (why, _) in enumerate(p.outcomes) if typed or why is not None]
            if some:
                at_rows = pa.array([p.strict[i] for i in some], pa.int64())
                values = [p.outcomes[i][1] for i in some]
                columns = {c: pa.array([v.get(c) for v in values], t) for c, t in TYPED if c in fmt.columns} if typed else {}
                yield [c.take(at_rows) for c in keep], pa.array([p.outcomes[i][0] for i in some], pa.string()), columns, len(some)


def _parser(passed: list[str], block: int, typed: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keep, reasons, columns, n in _parts(passed, batch, block, typed):
                more = [columns[c] if c in columns else pa.nulls(n, t) for c, t in TYPED] if typed else []
                yield pa.RecordBatch.from_arrays([*keep, reasons, *more], names=[*passed, "reason", *[c for c, _ in TYPED if typed]])

    return parse


def parse_lines(
    df: DataFrame, kind: str = "file_kind", text: str = "line_text", keep: tuple[str, ...] = ("line_id",), block: int = 8192, typed: bool = True
) -> DataFrame:
    """One row per data line: the ``keep`` columns, ``reason`` (null: the line is valid) and the typed
    columns of all formats (null where a format has none, or the line fails).

    Lines that start with ``#`` are no data and give no row. A null line counts as an empty one
    (``column_count``); a null or unknown kind gives ``unknown_kind``. Repeated lines give repeated
    rows. ``keep`` must not name a typed column or ``reason``. Large inputs are parsed
    where they lie, in blocks of ``block`` lines. Without ``typed`` only failing lines come out, as the
    ``keep`` columns and ``reason``.
    """
    clash = {"reason", *[c for c, _ in TYPED if typed]} & set(keep)
    if clash:
        raise ValueError(f"keep names output columns: {sorted(clash)}")
    names = {"int64": "long", "string": "string", "double": "double"}
    src = df.where(F.col(f"`{text}`").isNull() | ~F.col(f"`{text}`").startswith("#")).select(
        *[F.col(f"`{c}`") for c in keep], F.col(f"`{kind}`").alias("kind__"), F.col(f"`{text}`").alias("text__")
    )
    ddl = [f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep]
    ddl += ["reason string", *[f"`{c}` {names[str(t)]}" for c, t in TYPED if typed]]
    return spread(src).mapInArrow(_parser(list(keep), block, typed), ", ".join(ddl))


def failed_lines(df: DataFrame) -> DataFrame:
    """Problem 5: ``line_id, reason`` of each failing line."""
    return parse_lines(df, typed=False)
