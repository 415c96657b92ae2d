"""Large files read in byte ranges, whatever lines, quotes or strings they cut.

A range is scanned alone and says what it does to a reader that enters it in
any state; put together in the order of a file, these maps give the state every
range is entered in. Each range then reads the records that begin in it. All
functions give the same for any size of the ranges.
"""

from __future__ import annotations

import codecs
import csv
import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.functions import text as tx
from embedlake.sources.remote import open_for_reading

RANGE_BYTES = 32 << 20
# Opening a range takes about as long as reading so many bytes.
OPEN_BYTES = 128 << 10
# Beyond this a task reads more ranges, one after the other.
MOST_TASKS = 50_000
UTF8, LATIN1 = "UTF-8", "ISO-8859-1"
# Bytes that can hold the characters the delimiter is chosen from.
SAMPLE_BYTES = 4 * tx.DELIMITER_SAMPLE_CHARS
HEAD_BYTES = tx.HEADER_BYTES
TEXT_KINDS = ["csv", "json", "jsonl", "xml"]
STEP = 1 << 20

csv.field_size_limit(1 << 31)


def byte_ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """`files` with `begin, stop`, one row per range; an empty file has one empty range."""
    last = F.greatest(F.col("length") - 1, F.lit(0))
    ranges = files.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(size).cast("long"))).alias("begin"))
    return ranges.withColumn("stop", F.least(F.col("begin") + size, F.col("length")))


def spread(ranges: DataFrame) -> DataFrame:
    """Tasks of about RANGE_BYTES, or of one longer range, which is read alone.

    Rows are tiny, so AQE would put all of them into one task. With a task for
    every range, what the driver keeps of tasks and of the blocks between them
    would follow the number of ranges, not the bytes.
    """
    seen = ranges.agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("begin") + OPEN_BYTES).alias("bytes")).first()
    wanted = max(-(-(seen["bytes"] or 0) // RANGE_BYTES), 2 * ranges.sparkSession.sparkContext.defaultParallelism)
    return ranges.repartition(max(min(seen["n"], wanted, MOST_TASKS), 1), "path", "begin")


def _read(file, begin: int, stop: int) -> bytes:
    file.seek(begin)
    return file.read(stop - begin)


# ---- charset, NUL bytes and patterns --------------------------------------

_PATTERNS = re.compile(b"|".join(re.escape(p.encode()) for p in tx.FORMULA_PATTERNS), re.IGNORECASE)
_OVERLAP = max(map(len, tx.FORMULA_PATTERNS)) - 1


def _is_utf8(before: bytes, data: bytes, after: bytes, last: bool) -> bool:
    """Whether the characters that touch `data` are whole; neighbours give up to three bytes."""
    first = next((i for i in range(len(before) - 1, -1, -1) if before[i] & 0xC0 != 0x80), len(before))
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        # A character that ends before the range says nothing about it but may be decoded with it.
        decoder.decode(before[first:])
        decoder.decode(data)
        decoder.decode(after, final=last)
    except UnicodeDecodeError:
        return False
    return True


def _mark(file) -> int:
    """Length of the byte order mark."""
    return len(codecs.BOM_UTF8) if _read(file, 0, len(codecs.BOM_UTF8)) == codecs.BOM_UTF8 else 0


def _delimiter(file) -> str:
    head = _read(file, 0, SAMPLE_BYTES).removeprefix(codecs.BOM_UTF8)
    try:
        text = codecs.getincrementaldecoder("utf-8")().decode(head)
    except UnicodeDecodeError:
        text = head.decode("latin-1")
    text = text[: tx.DELIMITER_SAMPLE_CHARS]
    best = max(tx.DELIMITERS, key=text.count)
    return best if best in text else tx.DEFAULT_DELIMITER


# ---- CSV -------------------------------------------------------------------

# Where a reader stands before a byte: at the begin of a record or of a cell,
# inside a bare or a quoted cell, behind a quote inside a quoted cell.
RECORD, CELL, BARE, QUOTED, QUOTE = range(5)


class CsvScan:
    """Follows quotes over bytes; a quote opens a cell only at its begin.

    Behind the closing quote any other byte than a delimiter, a line break or a
    quote makes the cell a bare one. CR, LF and CR LF end records.
    """

    def __init__(self, delimiter: str):
        sep = re.escape(delimiter.encode())
        self.sep = delimiter.encode()
        self.opens = re.compile(b"(?:[\r\n]|" + sep + b')"')

    def run(self, data: bytes, state: int) -> tuple[int, np.ndarray]:
        """State behind `data`, and the places behind the line breaks that end records."""
        shut = []  # quoted stretches
        at, n = 0, len(data)
        while at < n:
            if state in (QUOTED, QUOTE) or data[at : at + 1] == b'"' and state in (RECORD, CELL):
                begin = at
                if state in (RECORD, CELL):
                    at += 1
                elif state == QUOTE:
                    if data[at : at + 1] != b'"':
                        state = BARE
                        continue
                    at += 1
                state = QUOTED
                while True:
                    found = data.find(b'"', at)
                    if found < 0:
                        at, end = n, QUOTED
                        break
                    if found + 1 == n:
                        at, end = n, QUOTE
                        break
                    if data[found + 1] == 0x22:
                        at = found + 2
                        continue
                    at, end = found + 1, BARE
                    break
                shut.append((begin, at))
                state = end
                continue
            found = self.opens.search(data, at)
            if found is None:
                break
            state, at = CELL, found.end() - 1
        if state in (RECORD, CELL, BARE) and n:
            tail = data[-1:]
            state = RECORD if tail in (b"\r", b"\n") else CELL if tail == self.sep else BARE
        places = np.frombuffer(data, "u1")
        places = np.flatnonzero((places == 10) | (places == 13))
        if shut and len(places):
            begins = np.array([b for b, _ in shut])
            ends = np.array([e for _, e in shut])
            inside = np.searchsorted(begins, places, "right") - 1
            places = places[(inside < 0) | (places >= ends[np.maximum(inside, 0)])]
        return state, places + 1

    def states(self, data: bytes) -> list[int]:
        """The state behind `data` for each state before it."""
        if not data:
            return list(range(5))
        first, quoted = self.run(data, RECORD)[0], self.run(data, QUOTED)[0]
        if data[0] != 0x22:
            return [first, first, first, quoted, first]
        return [first, first, self.run(data, BARE)[0], quoted, self.run(data, QUOTE)[0]]


# ---- JSON ------------------------------------------------------------------


def json_marks(data: bytes, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of brackets, commas, colons and quotes outside strings, the depth behind each, and
    whether the end is inside a string. `escaped`: the first byte follows an odd run of backslashes."""
    raw = np.frombuffer(data, "u1")
    quotes = np.flatnonzero(raw == 0x22)
    if len(quotes):
        slash = np.concatenate([[escaped], raw == 0x5C])
        # How many backslashes stand right before each quote; the one before the range counts as one.
        other = np.where(slash, -1, np.arange(len(slash)))
        run = quotes - np.maximum.accumulate(other)[quotes]
        quotes = quotes[run % 2 == 0]
    within = np.zeros(len(raw) + 1, "i1")
    within[quotes] = 1
    open_before = (np.cumsum(within) - within)[:-1] + inside  # quotes before each byte
    outside = open_before % 2 == 0
    marks = np.isin(raw, np.frombuffer(b"[]{},:", "u1")) & outside
    marks[quotes] = True
    places = np.flatnonzero(marks)
    kinds = raw[places]
    step = np.isin(kinds, [0x5B, 0x7B]).astype("i8") - np.isin(kinds, [0x5D, 0x7D])
    return places, np.cumsum(step), bool((len(quotes) + inside) % 2)


def _odd_run(data: bytes, before: bool) -> bool:
    """Whether an odd run of backslashes ends `data`; `before` tells the same of what precedes it."""
    bare = len(data) - len(data.rstrip(b"\\"))
    return (bare + (before and bare == len(data))) % 2 == 1


def _escaped(file, begin: int) -> bool:
    """Whether an odd run of backslashes ends right before a place."""
    run, at = 0, begin
    while at:
        low = max(0, at - 4096)
        part = _read(file, low, at)
        bare = len(part) - len(part.rstrip(b"\\"))
        run += bare
        if bare < len(part):
            break
        at = low
    return run % 2 == 1


# ---- first pass ------------------------------------------------------------

PROFILE = (
    "path string, length long, begin long, stop long, extension string, utf8 boolean, nul boolean, marked boolean, "
    "print long, delimiter string, shape string, opens long, states array<int>, deltas array<long>, problem string"
)


def _profiles(parts) -> Iterator[pa.RecordBatch]:
    """What every range holds; a file that can't be read is a row with a problem."""
    for part in parts:
        for row in part.to_pylist():
            out = dict.fromkeys(c.split()[0] for c in PROFILE.split(", "))
            out |= {k: row[k] for k in ("path", "length", "begin", "stop", "extension")}
            try:
                with open_for_reading(row["path"]) as file:
                    out |= _profile(file, row["begin"], row["stop"], row["length"], row["extension"])
            except OSError as failure:
                out["problem"] = str(failure)
            yield pa.RecordBatch.from_pylist([out], _PROFILE)


_KINDS = {
    "string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "int": pa.int32(),
}


def _arrow(columns: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in columns.split(", "))])


_PROFILE = _arrow(PROFILE)


def _profile(file, begin: int, stop: int, length: int, extension: str) -> dict:
    low = max(0, begin - 3)
    held = _read(file, low, min(stop + _OVERLAP, length))
    before, data, after = held[: begin - low], held[begin - low : stop - low], held[stop - low :]
    out = {
        "utf8": _is_utf8(before, data, after[:3], stop + 3 >= length),
        "nul": b"\x00" in data,
        "marked": _PATTERNS.search(held, begin - low) is not None,
        "print": xxhash.xxh64_intdigest(data, begin & 0xFFFFFFFF) - (1 << 63),
    }
    if extension == "csv":
        out["delimiter"] = _delimiter(file)
        out["states"] = CsvScan(out["delimiter"]).states(data[max(0, _mark(file) - begin) :])
    elif extension == "json":
        escaped, ends, deltas = _escaped(file, begin), [False, True], [0, 0]
        for at in range(0, len(data), STEP):
            part = data[at : at + STEP]
            for i in range(2):
                _, depth, ends[i] = json_marks(part, ends[i], escaped)
                deltas[i] += int(depth[-1]) if len(depth) else 0
            escaped = _odd_run(part, escaped)
        out |= {"states": [int(e) for e in ends], "deltas": deltas}
        if begin == 0:
            out["shape"], out["opens"] = _json_shape(file, length)
    return out


def _json_shape(file, length: int) -> tuple[str, int | None]:
    """array, object or envelope; for an array the place of its bracket.

    An object too large for the head can only be an envelope of `data`.
    """
    at = 0
    while at < length:
        part = _read(file, at, min(at + STEP, length))
        bare = part.removeprefix(codecs.BOM_UTF8) if at == 0 else part
        rest = bare.lstrip(b" \t\r\n")
        if rest:
            if rest[:1] == b"[":
                return "array", at + len(part) - len(rest)
            break
        at += len(part)
    if length <= HEAD_BYTES:
        raw = _read(file, 0, length).removeprefix(codecs.BOM_UTF8)
        try:
            found = json.loads(raw.decode("utf-8" if _is_utf8(b"", raw, b"", True) else "latin-1"))
            if isinstance(found, dict) and "data" not in found:
                return "object", None
        except ValueError:
            pass
    return "envelope", None


def profile(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """One row per byte range of `path, length, extension`: the columns of PROFILE.

    `utf8`, `nul` and `marked` (a formula pattern in either case begins in the
    range) hold for the file when put together over its ranges; `states` is the
    reader's state behind the range for each state before it, `deltas` what a
    JSON range adds to the depth; the first range tells the `shape` of a JSON
    file. `print` is a digest of the range. A task holds one range; every byte
    is read once, and a few around each cut. Formats that are not read as text
    get one range of a byte, which shows whether they can be opened.
    """
    text = F.col("extension").isin(*TEXT_KINDS)
    known = files.select("path", "length", "extension")
    ranges = byte_ranges(known.where(text), size).unionByName(
        known.where(~text).withColumns({"begin": F.lit(0).cast("long"), "stop": F.least(F.col("length"), F.lit(1))})
    )
    return spread(ranges).mapInArrow(_profiles, PROFILE)


ENTRY = "path string, length long, begin long, stop long, extension string, state int, depth long"
_ENTRY = _arrow(ENTRY)


def _compose(parts) -> Iterator[pa.RecordBatch]:
    """States before each range, from ranges in the order of their files."""
    path, state, depth = None, 0, 0
    for part in parts:
        rows = []
        for row in part.to_pylist():
            if row["path"] != path:
                path, state, depth = row["path"], RECORD, 0
            rows.append({k: row[k] for k in ("path", "length", "begin", "stop", "extension")} | {"state": state, "depth": depth})
            depth += row["deltas"][state] if row["deltas"] else 0
            state = row["states"][state]
        yield pa.RecordBatch.from_pylist(rows, _ENTRY)


def entered(profiles: DataFrame) -> DataFrame:
    """The state (and JSON depth) in which every range with `states` is entered.

    Ranges of a file go by in order, one small row each, so nothing is held.
    """
    known = profiles.where("states IS NOT NULL").select("path", "length", "begin", "stop", "extension", "states", "deltas")
    return known.repartition("path").sortWithinPartitions("path", "begin").mapInArrow(_compose, ENTRY)


# ---- records ---------------------------------------------------------------

CELLS = "path string, cells map<string,string>, malformed boolean"
_CELLS = pa.schema([("path", pa.string()), ("cells", pa.map_(pa.string(), pa.string())), ("malformed", pa.bool_())])
_VALUES = pa.schema([("path", pa.string()), ("value", pa.string())])
BATCH_ROWS = 2_000


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _csv_records(file, begin: int, stop: int, length: int, state: int, scan: CsvScan) -> Iterator[bytes]:
    """Records that begin in [begin, stop); the last one is followed beyond it."""
    # The byte order mark belongs to no record.
    at, waiting = max(begin, _mark(file)) if begin < len(codecs.BOM_UTF8) else begin, bytearray()
    if at >= stop:
        return
    mine = state == RECORD
    while at < length:
        data = _read(file, at, min(at + STEP, length))
        state, ends = scan.run(data, state)
        last = 0
        for end in ends.tolist():
            if mine:
                yield bytes(waiting) + data[last:end]
            waiting.clear()
            mine, last = at + end < stop, end
            if not mine and at + end >= stop:
                return
        if mine:
            waiting += data[last:]
        at += len(data)
        if at >= stop and not mine:
            return
    if mine and waiting:
        yield bytes(waiting)


def _cells(record: str, delimiter: str) -> list[str | None]:
    """Cells of one record; an empty bare cell is null, as a quoted one is not."""
    return next(csv.reader([record], delimiter=delimiter, quoting=csv.QUOTE_NOTNULL), [])


def header_names(cells: list[str | None]) -> list[str]:
    """Names of columns: empty and repeated ones are told apart by their place."""
    lowered = [c.lower() for c in cells if c]
    return [f"_c{i}" if not c else f"{c}{i}" if lowered.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def _csv_rows(parts) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for row in part.to_pylist():
            yield from _batches(_csv_range(**row), _CELLS)


def _csv_range(path, length, begin, stop, state, delimiter, encoding) -> Iterator[tuple]:
    scan = CsvScan(delimiter)
    with open_for_reading(path) as file:
        plain = lambda raw: raw.decode(encoding, "replace").rstrip("\r\n")
        heads = (plain(r) for r in _csv_records(file, 0, length, length, RECORD, scan))
        first = next((h for h in heads if h.strip()), None)
        names = header_names(_cells(first, delimiter)) if first is not None else []
        skip = begin == 0
        # Of a file whose first lines are blank the header may begin in a later range.
        for raw in _csv_records(file, begin, stop, length, state, scan) if begin == 0 else _after_header(file, begin, stop, length, state, scan):
            text = plain(raw)
            if not text.strip():
                continue
            if skip:
                skip = False
                continue
            cells = _cells(text, delimiter)
            yield path, list(zip(names, cells + [None] * (len(names) - len(cells)))), len(cells) > len(names)


def _after_header(file, begin: int, stop: int, length: int, state: int, scan: CsvScan) -> Iterator[bytes]:
    """Records of a later range, without the header if all before it is blank."""
    blank = not any(_read(file, at, min(at + STEP, begin)).strip() for at in range(_mark(file), begin, STEP))
    for raw in _csv_records(file, begin, stop, length, state, scan):
        if blank and raw.strip():
            blank = False
            continue
        yield raw


def csv_cells(ranges: DataFrame) -> DataFrame:
    """Cells by header of CSV ranges `path, length, begin, stop, state, delimiter, encoding`.

    A record with more cells than the header is malformed, a shorter one ends
    in nulls, blank lines are none. The header is the file's first record,
    whatever its length or line breaks. A task holds one record and a piece of
    its range.
    """
    names = ["path", "length", "begin", "stop", "state", "delimiter", "encoding"]
    return spread(ranges.select(*names)).mapInArrow(_csv_rows, CELLS)


def _lines(parts) -> Iterator[pa.RecordBatch]:
    def rows(path, length, begin, stop, encoding):
        with open_for_reading(path) as file:
            # A line that begins in the range follows a line break before it.
            fresh = begin == 0 or _read(file, begin - 1, begin) in (b"\n", b"\r")
            scan = CsvScan("\x00")
            scan.run = _line_ends
            for raw in _csv_records(file, begin, stop, length, RECORD if fresh else BARE, scan):
                text = raw.decode(encoding, "replace").rstrip("\r\n")
                if text.strip():
                    yield path, text

    for part in parts:
        for row in part.to_pylist():
            yield from _batches(rows(**row), _VALUES)


def _line_ends(data: bytes, state: int) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(data, "u1")
    return state, np.flatnonzero((raw == 10) | (raw == 13)) + 1


def text_lines(ranges: DataFrame) -> DataFrame:
    """`path, value` of the lines that are not blank; `ranges` has `path, length, begin, stop, encoding`."""
    names = ["path", "length", "begin", "stop", "encoding"]
    return spread(ranges.select(*names)).mapInArrow(_lines, "path string, value string")


# ---- JSON arrays -----------------------------------------------------------

FOUND = "path string, opens array<long>, closes array<long>"


def _data_keys(parts) -> Iterator[pa.RecordBatch]:
    """Per range: where an array of the outermost key "data" opens, and where arrays of that depth close first."""
    for part in parts:
        for row in part.to_pylist():
            opens, closes, due = [], [], True
            inside, depth = bool(row["state"]), row["depth"]
            with open_for_reading(row["path"]) as file:
                for at in range(row["begin"], row["stop"], STEP):
                    data = _read(file, at, min(at + STEP, row["stop"]))
                    places, deep, inside = json_marks(data, inside, _escaped(file, at))
                    kinds, deep = np.frombuffer(data, "u1")[places], deep + depth
                    depth = int(deep[-1]) if len(deep) else depth
                    told = (kinds == 0x5D) & (deep == 1) | (kinds == 0x5B) & (deep == 2)
                    for place, kind in zip((places[told] + at).tolist(), kinds[told].tolist()):
                        if kind == 0x5D and due:
                            closes.append(place)
                            due = False
                        elif kind == 0x5B and _key_before(file, place) == "data":
                            opens.append(place)
                            due = True
            yield pa.RecordBatch.from_pylist([{"path": row["path"], "opens": opens[:1], "closes": closes}], _arrow(FOUND))


def _key_before(file, at: int) -> str | None:
    """The key whose value opens at `at`; keys of over 1,000 bytes are not looked at."""
    found = re.search(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', _read(file, max(0, at - 1024), at))
    if found is None:
        return None
    return json.loads(b'"' + found[1] + b'"')


def data_arrays(ranges: DataFrame) -> DataFrame:
    """`path, opens, closes`: the array of the key "data" of objects, from entered JSON ranges."""
    found = spread(ranges.select("path", "begin", "stop", "state", "depth")).mapInArrow(_data_keys, FOUND)
    opens = found.select("path", F.explode("opens").alias("at")).groupBy("path").agg(F.min("at").alias("opens"))
    closes = found.select("path", F.explode("closes").alias("at")).join(opens, "path").where("at > opens")
    return opens.join(closes.groupBy("path").agg(F.min("at").alias("closes")), "path", "left")


def _items(parts) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for row in part.to_pylist():
            yield from _batches(_item_range(**row), _VALUES)


def _item_range(path, length, begin, stop, state, depth, level, opens, closes, encoding) -> Iterator[tuple]:
    """Elements of an array that begin in [begin, stop): behind its bracket or a comma of its level."""
    end_of = length if closes is None else closes + 1
    with open_for_reading(path) as file:
        at, waiting, mine = begin, bytearray(), False
        inside = bool(state)
        while at < end_of:
            data = _read(file, at, min(at + STEP, end_of))
            if not data:
                return
            places, deep, inside_after = json_marks(data, inside, _escaped(file, at))
            kinds = np.frombuffer(data, "u1")[places]
            deep = deep + depth
            cut = ((kinds == 0x2C) & (deep == level)) | ((kinds == 0x5B) & (deep == level)) & (places + at == opens)
            cut |= (kinds == 0x5D) & (deep == level - 1) & (places + at >= opens)
            cut &= places + at >= opens
            last = 0
            for place, kind in zip(places[cut].tolist(), kinds[cut].tolist()):
                if mine:
                    text = (bytes(waiting) + data[last:place]).decode(encoding, "replace").strip()
                    # An array without elements has nothing between its brackets.
                    if text or kind == 0x2C:
                        yield path, text
                waiting.clear()
                mine, last = kind != 0x5D and at + place < stop, place + 1
                if at + place >= stop or kind == 0x5D:
                    return
            if mine:
                waiting += data[last:]
            depth = int(deep[-1]) if len(deep) else depth
            inside, at = inside_after, at + len(data)
            if at >= stop and not mine:
                return
        # The array never closes: what is left is no element, so the file is refused.
        if mine:
            yield path, ""


def array_items(ranges: DataFrame) -> DataFrame:
    """`path, value`: texts of the elements of JSON arrays, cut over any number of tasks.

    `ranges` are entered ranges with `encoding`, `level` (1 for an array, 2 for
    one inside an object), and the places `opens` and `closes` of its brackets
    (a null `closes` goes to the end). An element that never ends, or is empty,
    comes as it is, so that it can be refused. A task holds one element and a
    piece of its range.
    """
    names = ["path", "length", "begin", "stop", "state", "depth", "level", "opens", "closes", "encoding"]
    return spread(ranges.select(*names)).mapInArrow(_items, "path string, value string")


# ---- whole small documents and XML -----------------------------------------


def _files(files: DataFrame) -> DataFrame:
    whole = files.select("path", "encoding", F.lit(0).cast("long").alias("begin"), F.col("length").alias("stop"))
    return spread(whole).select("path", "encoding")


def _flat(value, name: str, out: dict[str, str | None]) -> None:
    if isinstance(value, dict):
        for key, inner in value.items():
            _flat(inner, f"{name}.{key}" if name else key, out)
    else:
        out[name] = value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _objects(parts) -> Iterator[pa.RecordBatch]:
    def rows():
        for part in parts:
            for row in part.to_pylist():
                out: dict[str, str | None] = {}
                with open_for_reading(row["path"]) as file:
                    try:
                        _flat(json.loads(file.read().decode(row["encoding"]).removeprefix("﻿")), "", out)
                    except ValueError:
                        out = {}
                yield row["path"], [(k, v) for k, v in out.items() if v is not None] if out else None, not out

    yield from _batches(rows(), _CELLS)


def object_cells(files: DataFrame) -> DataFrame:
    """One row of dotted columns per file of `path, length, encoding` that is one JSON object; these fit the head."""
    return _files(files).mapInArrow(_objects, CELLS)


def _xml_rows(parts) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for row in part.to_pylist():
            yield from _batches(_xml_records(**row), _CELLS)


def _xml_records(path: str, encoding: str) -> Iterator[tuple]:
    """Children of the root as records of their own children's text."""
    parser = None if encoding == UTF8 else ElementTree.XMLParser(encoding="iso-8859-1")
    with open_for_reading(path) as file:
        try:
            depth, root = 0, None
            for event, node in ElementTree.iterparse(file, ("start", "end"), parser):
                depth += 1 if event == "start" else -1
                if event == "start" and root is None:
                    root = node
                if event == "end" and depth == 1:
                    cells = {child.tag.rsplit("}", 1)[-1]: child.text or "" for child in node}
                    yield path, list(cells.items()), False
                    root.clear()
        except ElementTree.ParseError:
            yield path, None, True


def xml_cells(files: DataFrame) -> DataFrame:
    """Cells of XML files `path, length, encoding`; a record has the columns it has, a missing text is empty.

    A file streams through one task, which holds one record of it.
    """
    return _files(files).mapInArrow(_xml_rows, CELLS)
