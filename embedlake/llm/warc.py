"""Web archives whose repeated payloads are revisit records.

Archives are gzip members, one record each, after a warcinfo record. Records
are resolved by their headers alone: those of equal payload digest meet, one
response stays the original, and every archive is then written anew by the task
that reads it, so payloads are never shuffled.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.llm.frames import _open
from embedlake.session import work_dir

# Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"

LEAST_BYTES = 100
# An archive ends after so many bytes of payload or so many records.
FILE_BYTES, FILE_RECORDS = 64 << 20, 50_000
# Raw archives are read once and written anew.
RAW_LEVEL = 1
CHUNK = 1 << 20
OWN_IDS = uuid.UUID("6f1c1d2e-3a55-4c57-9a5b-7f1f6a0f5c11")

INDEX = (
    "path string, ordinal long, record_type string, record_id string, date string, url string, "
    "page_id string, payload_digest string, payload_bytes long, refers_to string"
)
_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(_NAMES, kinds)], _NAMES)


def _clean(value: str) -> str:
    """A header value on one line: controls and per cent signs become %XX."""
    return "".join(c if c >= " " and c not in "%\x7f" else f"%{ord(c):02X}" for c in value)


def _plain(value: str | None) -> str | None:
    """The value that `_clean` wrote."""
    if value is None or "%" not in value:
        return value
    head, *rest = value.split("%")
    return head + "".join(chr(int(r[:2], 16)) + r[2:] for r in rest)


class _Bytes:
    """Reads the bytes of an archive in order, gzip members or not."""

    def __init__(self, source):
        self.source, self.held, self.zip = source, bytearray(), None
        first = source.read(CHUNK)
        self.raw, self.packed = first, first[:2] == b"\x1f\x8b"

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(CHUNK)
            if not self.raw:
                if self.zip is not None and not self.zip.eof:
                    raise ValueError("the archive ends inside a record")
                return False
        if not self.packed:
            self.held += self.raw
            self.raw = b""
            return True
        if self.zip is None or self.zip.eof:
            self.zip = zlib.decompressobj(31)
        self.held += self.zip.decompress(self.raw)
        self.raw = self.zip.unused_data
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with `mark`; None at the end of the archive."""
        looked = 0
        while (at := self.held.find(mark, looked)) < 0:
            looked = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a header")
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins blank goes on the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of an archive."""
    system, name = _open(path)
    with system.open_input_stream(name, compression=None) as source:
        held = _Bytes(source)
        while (head := held.until(b"\r\n\r\n")) is not None:
            fields = _fields(head.lstrip())
            yield fields, held.take(int(fields["content-length"]))
            held.take(4)


def _split(fields: dict[str, str], block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head of a block, with its blank line, and the payload."""
    if not fields.get("content-type", "").startswith("application/http"):
        return b"", block
    at = block.find(b"\r\n\r\n")
    return (block, b"") if at < 0 else (block[: at + 4], block[at + 4 :])


class Writer:
    """Writes one archive of gzip members."""

    def __init__(self, path: str, date: str, level: int = 6):
        system, name = _open(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        self.path, self.date, self.level, self.n, self.bytes = path, date, level, 0, 0
        self.sink = system.open_output_stream(name, compression=None)
        info = b"software: embedlake\r\nformat: WARC File Format 1.1\r\n"
        self._put(_record("warcinfo", str(uuid.uuid4()), date, info, {"Content-Type": "application/warc-fields"}))

    def _put(self, record: bytes) -> None:
        self.sink.write(gzip.compress(record, self.level, mtime=0))

    def add(self, record: bytes) -> int:
        """The record's place among those added."""
        self._put(record)
        self.n += 1
        self.bytes += len(record)
        return self.n - 1

    @property
    def full(self) -> bool:
        return self.n >= FILE_RECORDS or self.bytes >= FILE_BYTES

    def close(self) -> None:
        self.sink.close()


def _record(kind: str, record_id: str, date: str, block: bytes, fields: dict[str, str | None]) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}"]
    lines += [f"{k}: {v}" for k, v in fields.items() if v is not None]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def write(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", level: int = 6
) -> DataFrame:
    """Archives of one response record per row below `folder`, and their index.

    The index has the columns of INDEX, one row per record, and is kept in
    `folder/_index`; it names only files of attempts that counted. A null html
    is empty; a null url or id leaves its header out; line breaks and other
    controls in them are written as %XX and read back as they were. Rows may
    repeat. An empty table gives no archive and an empty index. Other columns
    are not read. A task holds one record at a time, whatever its length.
    """
    date = _now()

    def save(parts):
        part, attempt, number, out = TaskContext.get().partitionId(), uuid.uuid4().hex[:8], 0, None
        rows = []
        try:
            for batch in parts:
                for n in range(batch.num_rows):
                    key, at, text = (batch.column(i)[n].as_py() for i in range(3))
                    payload = (text or "").encode()
                    if out is None:
                        out = Writer(f"{folder}/raw-{part:06d}-{attempt}-{number:04d}.warc.gz", date, level)
                    row = {
                        "path": out.path, "record_type": "response", "record_id": str(uuid.uuid4()), "date": date,
                        "url": at, "page_id": key, "payload_digest": hashlib.sha256(payload).hexdigest(),
                        "payload_bytes": len(payload),
                    }
                    row["ordinal"] = out.add(_response(row, _http(len(payload)) + payload))
                    rows.append(row)
                    if out.full:
                        out.close()
                        yield _batch(rows)
                        rows, out, number = [], None, number + 1
        finally:
            if out:
                out.close()
        if rows:
            yield _batch(rows)

    held = pages.select(F.col(page_id).cast("string"), F.col(url).cast("string"), F.col(html).cast("string"))
    held.mapInArrow(save, INDEX).write.parquet(f"{folder}/_index")
    return pages.sparkSession.read.parquet(f"{folder}/_index")


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _digest(value: str | None) -> str | None:
    return value if value is None or ":" in value else f"sha256:{value}"


def _headers(row: dict) -> dict[str, str | None]:
    return {
        "WARC-Target-URI": None if row["url"] is None else _clean(row["url"]),
        "Page-ID": None if row["page_id"] is None else _clean(row["page_id"]),
        "WARC-Payload-Digest": _digest(row["payload_digest"]),
        "Content-Type": HTTP,
    }


def _response(row: dict, block: bytes) -> bytes:
    return _record("response", row["record_id"], row["date"], block, _headers(row))


def _revisit(row: dict, head: bytes) -> bytes:
    more = {
        "WARC-Profile": SAME_PAYLOAD,
        "WARC-Refers-To": None if row["refers_to"] is None else f"<urn:uuid:{row['refers_to']}>",
        "WARC-Refers-To-Target-URI": None if row["original_url"] is None else _clean(row["original_url"]),
        "WARC-Refers-To-Date": row["original_date"],
        "WARC-Truncated": "length",
    }
    return _record("revisit", row["record_id"], row["date"], head, _headers(row) | more)


def _bare(record_id: str | None) -> str | None:
    return None if record_id is None else record_id.strip("<>").removeprefix("urn:uuid:")


def _size(head: bytes) -> int | None:
    """The length that an HTTP head gives."""
    value = _fields(head).get("content-length", "")
    return int(value) if value.isascii() and value.isdigit() else None


def _rows(path: str) -> Iterator[tuple[dict, bytes, bytes]]:
    """Index row, HTTP head and payload of the responses and revisits of an archive.

    A payload is held against its own digest. A revisit's full length is that
    of its HTTP head, and null where the head has none.
    """
    ordinal = 0
    for fields, block in records(path):
        kind = fields.get("warc-type", "")
        if kind not in ("response", "revisit"):
            continue
        head, payload = _split(fields, block)
        said = fields.get("warc-payload-digest", "")
        found = hashlib.sha256(payload).hexdigest()
        if kind == "response":
            if said.startswith("sha256:") and said[7:] != found:
                raise ValueError(f"payload {fields.get('warc-record-id')} of {path} is damaged")
            digest, size = found, len(payload)
        else:
            digest, size = said.removeprefix("sha256:") or None, _size(head)
        row = {
            "path": path, "ordinal": ordinal, "record_type": kind, "record_id": _bare(fields.get("warc-record-id")),
            "date": fields.get("warc-date"), "url": _plain(fields.get("warc-target-uri")),
            "page_id": _plain(fields.get("page-id")), "payload_digest": digest, "payload_bytes": size,
            "refers_to": _bare(fields.get("warc-refers-to")),
        }
        ordinal += 1
        yield row, head, payload


def scan(files: DataFrame) -> DataFrame:
    """The index of archives, read from the archives themselves; `files` has `path`.

    Responses and revisits get a row each, in their order; other records
    (requests, metadata, warcinfo) have none. A payload that does not fit its
    SHA-256 fails the job. No files give no rows.
    """

    def load(parts):
        for part in parts:
            for path in part.column("path").to_pylist():
                rows = []
                for row, _, _ in _rows(path):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return _spread(files.select("path").distinct(), "path").mapInArrow(load, INDEX)


def _spread(files: DataFrame, key: str) -> DataFrame:
    """One archive per task or so; they are bounded in size."""
    return files.repartition(max(files.count(), 1), key)


def resolve(index: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """The records that become or stay revisits, each with its original.

    Of the responses with one digest and at least `least` bytes the smallest
    page_id is the original, null ids last, ids of digits by their number;
    among rows of one page_id it is the smallest record id. Every other
    response with that digest, and every old revisit of it, gets a row `path,
    ordinal, refers_to, original_page, original_url, original_date`; an old
    revisit whose original is in no archive, or whose digest is not a SHA-256,
    gets none. A digest of a third of
    all records is one row per task before it is shuffled, and its join is
    split by AQE; only headers move.
    """
    number = F.expr("try_cast(page_id AS BIGINT)")
    heads = index.where((F.col("record_type") == "revisit") | (F.col("payload_bytes") >= least)).select(
        "path", "ordinal", "record_type", "record_id", "payload_digest", "page_id", number.alias("number"), "url", "date"
    )
    real = F.col("record_type") == "response"
    groups = heads.groupBy("payload_digest").agg(
        F.count("*").alias("n"),
        F.count_if(real).alias("responses"),
        F.min(F.when(real, F.col("number"))).alias("low"),
        F.min(F.when(real & F.col("number").isNull(), F.col("page_id"))).alias("low_text"),
    )
    groups = groups.where("n > 1 AND responses > 0").drop("n", "responses")
    least_rows = heads.where(real).join(groups, "payload_digest").where(
        F.col("number").eqNullSafe(F.col("low"))
        & (F.col("low").isNotNull() | F.col("page_id").eqNullSafe(F.col("low_text")))
    )
    first = least_rows.groupBy("payload_digest").agg(
        F.min(F.struct("record_id", "page_id", "url", "date")).alias("first")
    )
    joined = heads.join(first, "payload_digest").where(~real | (F.col("record_id") != F.col("first.record_id")))
    return joined.select(
        "path", "ordinal", F.col("first.record_id").alias("refers_to"), F.col("first.page_id").alias("original_page"),
        F.col("first.url").alias("original_url"), F.col("first.date").alias("original_date"),
    )


def fresh_id(record_id: str) -> str:
    """The id of a record's new copy; the same wherever it is asked for."""
    return str(uuid.uuid5(OWN_IDS, record_id))


def rewrite(files: DataFrame, revisits: DataFrame, folder: str) -> DataFrame:
    """New archives below `folder`, one for each of `files`; returns `path`.

    Every response and revisit is written again with new ids, dates, lengths
    and digests: rows of `revisits` as revisit records without their payload,
    responses whole, old revisits without an original as they were. The list of
    revisits per archive is bounded by the archive. The manifest in
    `folder/_files` names only files of attempts that counted.
    """
    spark, date = files.sparkSession, _now()

    def save(parts):
        part, attempt, number = TaskContext.get().partitionId(), uuid.uuid4().hex[:8], 0
        for batch in parts:
            for path, found in zip(batch.column("path").to_pylist(), batch.column("found").to_pylist()):
                known = {f["ordinal"]: f for f in found or []}
                out = Writer(f"{folder}/part-{part:06d}-{attempt}-{number:04d}.warc.gz", date)
                number += 1
                try:
                    for row, head, payload in _rows(path):
                        row |= {"record_id": fresh_id(row["record_id"] or f"{path} {row['ordinal']}"), "date": date}
                        if row["ordinal"] in known:
                            to = known[row["ordinal"]]
                            row |= to | {"refers_to": fresh_id(to["refers_to"]), "original_date": date}
                            out.add(_revisit(row, head))
                        elif row["record_type"] == "revisit":
                            out.add(_revisit(row | {"original_url": None, "original_date": None}, head))
                        else:
                            out.add(_response(row, head + payload))
                finally:
                    out.close()
                yield pa.RecordBatch.from_pydict({"path": [out.path]})

    listed = revisits.groupBy("path").agg(
        F.collect_list(F.struct("ordinal", "refers_to", "original_url", "original_date")).alias("found")
    )
    held = files.select("path").distinct().join(listed, "path", "left")
    _spread(held, "path").mapInArrow(save, "path string").write.parquet(f"{folder}/_files")
    return spark.read.parquet(f"{folder}/_files")


def deduplicate(files: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Resolve the revisits of archives and write deduplicated ones below `folder`."""
    return rewrite(files, resolve(scan(files), least), folder)


def referred(index: DataFrame) -> DataFrame:
    """The index with `refers_page`: the page_id of the response that a revisit names."""
    names = index.where("record_type = 'revisit'").select(F.col("refers_to").alias("named")).distinct()
    responses = index.where("record_type = 'response'").select(F.col("record_id").alias("named"), F.col("page_id").alias("refers_page"))
    return index.join(responses.join(names, "named"), F.col("refers_to") == F.col("named"), "left").drop("named")


def archived_pages(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Pages written as deduplicated archives, and what the archives then say.

    Returns the index of the archives with `refers_page`. Raw archives lie in
    `folder/raw`, deduplicated ones in `folder/deduplicated`.
    """
    folder = folder or work_dir(pages.sparkSession, "warc")
    index = write(pages, f"{folder}/raw", level=RAW_LEVEL)
    files = rewrite(index.select("path").distinct(), resolve(index, least), f"{folder}/deduplicated")
    return referred(scan(files))
