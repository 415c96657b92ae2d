"""Token ids in binary files of independent zstandard frames with a seek table.

A file holds, one after the other:

* zstandard frames, each readable alone, with the zstandard content checksum;
* a skippable frame with the document index (ids, lengths, id width);
* a skippable frame in the public seekable format: sizes and a checksum of
  every frame, then the footer that says how many there are.

A reader takes the footer and the index from the end and decompresses only the
frames that hold the requested documents.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embedlake.llm import batches, encoding
from embedlake.session import work_dir

# Fixed numbers of the public zstandard seekable format.
SEEK_FRAME, INDEX_FRAME, SEEK_MAGIC, WITH_CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80
FRAME_IDS = 1 << 15
END_ID = 1


def _open(path: str):
    """File system and path of a shared folder, by its scheme."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class Writer:
    """Writes one file; documents come in the order they are to be read."""

    def __init__(self, path: str, id_bytes: int, frame_ids: int = FRAME_IDS):
        import zstandard

        self.system, self.path = _open(path)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.sink = self.system.open_output_stream(self.path, compression=None)
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.kind, self.frame_bytes = f"<u{id_bytes}", frame_ids * id_bytes
        self.waiting, self.held = [], 0
        self.table: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        data = memoryview(ids.astype(self.kind).tobytes())
        while len(data):
            part = data[: self.frame_bytes - self.held]
            self.waiting.append(part)
            self.held += len(part)
            data = data[len(part) :]
            if self.held == self.frame_bytes:
                self._frame()

    def _frame(self) -> None:
        import xxhash

        data = b"".join(self.waiting)
        packed = self.packer.compress(data)
        self.sink.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.waiting, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        known = np.array([d is not None for d in self.doc_ids], "u1")
        index = self.packer.compress(
            np.array([d or 0 for d in self.doc_ids], "<i8").tobytes()
            + np.array(self.lengths, "<i8").tobytes()
            + known.tobytes()
        )
        head = struct.pack("<QB", len(self.doc_ids), int(self.kind[-1]))
        self.sink.write(struct.pack("<II", INDEX_FRAME, len(head) + len(index)) + head + index)
        rows = b"".join(struct.pack("<III", *row) for row in self.table)
        footer = struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_FRAME, len(rows) + len(footer)) + rows + footer)
        self.sink.close()


class Reader:
    """Random access to one file; every frame read is checked."""

    def __init__(self, path: str):
        import zstandard

        system, path = _open(path)
        self.source = system.open_input_file(path)
        self.unpacker = zstandard.ZstdDecompressor()
        size = self.source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        rows = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3)
        self.checks = rows[:, 2]
        self.begins = np.concatenate([[0], np.cumsum(rows[:, 0], dtype="i8")])
        self.filled = np.concatenate([[0], np.cumsum(rows[:, 1], dtype="i8")])
        kind, length = struct.unpack("<II", self._at(int(self.begins[-1]), 8))
        if kind != INDEX_FRAME:
            raise ValueError(f"{path} has no document index")
        body = self._at(int(self.begins[-1]) + 8, length)
        n, self.width = struct.unpack("<QB", body[:9])
        index = self.unpacker.decompress(body[9:])
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.lengths = np.frombuffer(index, "<i8", n, 8 * n)
        self.known = np.frombuffer(index, "u1", n, 16 * n).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.loaded, self.frames_read = (-1, b""), 0

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def _frame(self, number: int) -> bytes:
        import xxhash

        if self.loaded[0] != number:
            begin, end = int(self.begins[number]), int(self.begins[number + 1])
            data = self.unpacker.decompress(self._at(begin, end - begin))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.checks[number]):
                raise ValueError(f"frame {number} is damaged")
            self.loaded, self.frames_read = (number, data), self.frames_read + 1
        return self.loaded[1]

    def pieces(self, row: int) -> Iterator[np.ndarray]:
        """The ids of the row-th document, frame by frame."""
        at, end = int(self.starts[row]) * self.width, int(self.starts[row + 1]) * self.width
        while at < end:
            number = int(np.searchsorted(self.filled, at, "right")) - 1
            stop = min(end, int(self.filled[number + 1]))
            data = self._frame(number)[at - int(self.filled[number]) : stop - int(self.filled[number])]
            yield np.frombuffer(data, f"<u{self.width}")
            at = stop

    def documents(self, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
        """Ids of the named documents; equal doc_ids give several entries."""
        rows = np.flatnonzero(self.known & np.isin(self.doc_ids, doc_ids))
        found: dict[int, list[np.ndarray]] = {}
        for row in rows:
            ids = np.concatenate([np.empty(0, "<u4"), *self.pieces(int(row))]).astype("<u4")
            found.setdefault(int(self.doc_ids[row]), []).append(ids)
        return found

    def close(self) -> None:
        self.source.close()


def write(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all documents in ascending doc_id order into files below `folder`.

    Returns the manifest `part, path, n_docs, n_tokens, start`, which is also
    kept in `folder/_manifest`. Ranges of doc_id go to one file each; rows with
    a null doc_id come first, rows with equal doc_id are ordered by text. A
    null or empty text is written as the end id alone. An empty table gives an
    empty manifest. A task that runs again writes a new file, and the manifest
    names that of the attempt that counted.
    """
    spark = docs.sparkSession

    def save(parts):
        encode = encoding.encoder(tokenizer)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        path, out = f"{folder}/part-{part:06d}-{attempt}.zst", None
        try:
            for piece in batches.slices(parts):
                for key, ids in zip(piece.column("doc_id").to_pylist(), encode.encode_all(batches.texts(piece))):
                    out = out or Writer(path, encode.id_bytes)
                    out.add(key, np.frombuffer(ids + END_ID.to_bytes(4, "little"), "<u4"))
        finally:
            if out:
                out.close()
        if out:
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], "int64"),
                    "path": [path],
                    "n_docs": pa.array([len(out.lengths)], "int64"),
                    "n_tokens": pa.array([sum(out.lengths)], "int64"),
                }
            )

    rows = batches.take(docs, doc_id=doc_id, text=text)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    listed = ordered.mapInArrow(save, "part long, path string, n_docs long, n_tokens long")
    listed.write.parquet(f"{folder}/_manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files in reading order, with the number of ids before each."""
    # One row per file, so this window is small whatever the documents hold.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = spark.read.parquet(f"{folder}/_manifest")
    return listed.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(listed: DataFrame) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` of every document in the files."""

    def load(parts):
        for part in parts:
            for path, start in zip(part.column("path").to_pylist(), part.column("start").to_pylist()):
                file = Reader(path)
                checks = []
                for row in range(len(file.lengths)):
                    check = 0
                    for ids in file.pieces(row):
                        check = zlib.crc32(ids.astype("<u4").tobytes(), check)
                    checks.append(check)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(file.doc_ids, mask=~file.known),
                        "start": pa.array(file.starts[:-1] + start, "int64"),
                        "n_tokens": pa.array(file.lengths, "int64"),
                        "ids_crc32": pa.array(checks, "int64"),
                    }
                )
                file.close()

    files = listed.count()
    spread = listed.select("path", "start", "part").repartition(max(files, 1), "part")
    return spread.select("path", "start").mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return work_dir(spark, "tokens")
