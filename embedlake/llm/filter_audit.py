"""Which filter removes what, in every order of applying them.

The words of all documents go into a sparse document-term matrix: a dictionary
gives every distinct word of the table one number, and shards of documents hold
their counts in compressed sparse rows (`indptr, indices, data`). Row sums are
word counts, entries per row are distinct words. With the remaining flags each
document is one mask of failed filters, and the audit is an aggregate over the
counts per part and mask.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import ipc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedlake.llm import batches
from embedlake.llm.frames import _open
from embedlake.session import cut_lineage, work_dir

# Bytes of text in one shard; a longer text is a shard of its own.
SHARD_BYTES = 8 << 20
# Words of shards that one hash bucket of the dictionary takes on average.
BUCKET_WORDS = 500_000
# Bytes of text counted at once; a longer text is cut at blanks.
PIECE_BYTES = 4 << 20
CHUNK = 1 << 20
MOST_TASKS = 50_000

FEWEST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
SYMBOLS = "#$%&*|"

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_FACTS = {"digest": pa.binary(), "chars": pa.int64(), "capitals": pa.int64(), "symbols": pa.int64()}


def _pieces(texts: pa.Array, limit: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Texts with their rows; a text beyond `limit` comes alone and in pieces."""
    if len(texts) != 1 or pc.binary_length(texts)[0].as_py() <= limit:
        yield np.arange(len(texts)), texts
        return
    raw, at = memoryview(texts.cast(pa.large_binary())[0].as_buffer()), 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + limit) if at + limit < len(raw) else None
        end = cut.start() if cut else len(raw)
        yield np.zeros(1, "i8"), pa.array([bytes(raw[at:end])], pa.large_string())
        at = end


def _facts(raw: bytes) -> tuple[bytes, int, int, int]:
    """Digest, code points, capitals A-Z and symbols of a text."""
    found, data = np.zeros(256, "i8"), np.frombuffer(raw, "u1")
    for at in range(0, len(data), CHUNK):
        found += np.bincount(data[at : at + CHUNK], minlength=256)
    follow, capitals = found[0x80:0xC0].sum(), found[ord("A") : ord("Z") + 1].sum()
    symbols = found[list(SYMBOLS.encode())].sum()
    return hashlib.sha256(raw).digest(), int(len(data) - follow), int(capitals), int(symbols)


class _Shard:
    """Counts of a run of documents over a dictionary of their own words."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.docs: list[dict] = []
        self.sizes: list[np.ndarray] = []
        self.indices: list[np.ndarray] = []
        self.data: list[np.ndarray] = []
        self.bytes = 0

    def add(self, keys: list[dict], texts: pa.Array) -> None:
        keyed, counted = [], []
        for rows, piece in _pieces(texts, PIECE_BYTES):
            lists = pc.ascii_split_whitespace(piece)
            words = lists.flatten().dictionary_encode()
            # Blanks at an end, or in a row, leave empty words.
            codes = np.fromiter((self._code(w) for w in words.dictionary.to_pylist()), "i8", len(words.dictionary))
            row = np.repeat(rows, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            code = codes[words.indices.to_numpy()] if len(words) else np.empty(0, "i8")
            row, code = row[code >= 0], code[code >= 0]
            key, count = np.unique(row.astype("i8") << 32 | code, return_counts=True)
            keyed.append(key)
            counted.append(count)
        key, count = np.concatenate(keyed), np.concatenate(counted)
        if len(keyed) > 1:
            key, place = np.unique(key, return_inverse=True)
            count = np.bincount(place, count, len(key)).astype("i8")
        self.sizes.append(np.bincount(key >> 32, minlength=len(keys)))
        self.indices.append((key & 0xFFFFFFFF).astype("i4"))
        self.data.append(count.astype("i4"))
        self.docs += keys

    def _code(self, word: str) -> int:
        return self.codes.setdefault(word, len(self.codes)) if word else -1

    def save(self, path: str, keys: pa.StructType) -> None:
        """One compressed Arrow record; codes follow the order of the words' hashes."""
        kind = pa.list_(pa.struct([*keys, *[pa.field(n, k) for n, k in _FACTS.items()]]))
        indptr = np.concatenate([[0], np.cumsum(np.concatenate(self.sizes))]).astype("i8")
        words = [w.encode() for w in self.codes]
        hashes = np.fromiter(map(zlib.crc32, words), "u4", len(words))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(words), "i4")
        rank[order] = np.arange(len(words))
        record = pa.RecordBatch.from_pydict(
            {
                "docs": pa.array([self.docs], kind),
                "indptr": pa.array([indptr], pa.list_(pa.int64())),
                "codes": pa.array([rank[np.concatenate(self.indices)]], pa.list_(pa.int32())),
                "data": pa.array([np.concatenate(self.data)], pa.list_(pa.int32())),
                "words": pa.array([b" ".join([words[i] for i in order])], pa.large_binary()),
                "hashes": pa.array([hashes[order]], pa.list_(pa.uint32())),
            }
        )
        system, name = _open(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        with system.open_output_stream(name, compression=None) as sink:
            with ipc.new_file(sink, record.schema, options=ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write(record)


def _load(path: str, *names: str) -> pa.RecordBatch:
    system, name = _open(path)
    with system.open_input_file(name) as source:
        fields = ipc.open_file(source).schema.names
        options = ipc.IpcReadOptions(included_fields=[fields.index(n) for n in names])
        return ipc.open_file(source, options=options).get_batch(0)


def _local_shards(docs: DataFrame, keys: list[str], text: str, folder: str) -> DataFrame:
    """`shard, path, n_words` of shards whose counts lie in files of attempts that counted."""
    held = docs.select(F.struct(*keys).alias("key"), F.col(text).alias("text"))

    def count(parts):
        part, attempt, number, shard, kind = TaskContext.get().partitionId(), uuid.uuid4().hex[:8], 0, _Shard(), None

        def row():
            path = f"{folder}/counts/{part:06d}-{number:04d}-{attempt}.arrow"
            shard.save(path, kind)
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([part << 32 | number], "int64"),
                    "path": [path],
                    "n_words": pa.array([len(shard.codes)], "int64"),
                }
            )

        for piece in batches.slices(parts, limit=PIECE_BYTES):
            texts, kind = pc.fill_null(piece.column("text"), ""), piece.schema.field("key").type
            size = int(pc.sum(pc.binary_length(texts)).as_py() or 0)
            if shard.docs and shard.bytes + size > SHARD_BYTES:
                yield row()
                number, shard = number + 1, _Shard()
            raw = texts.cast(pa.large_binary())
            found = [dict(zip(_FACTS, _facts(raw[i].as_py()))) for i in range(len(raw))]
            shard.add([k | f for k, f in zip(piece.column("key").to_pylist(), found)], texts)
            shard.bytes += size
        if shard.docs:
            yield row()

    return held.mapInArrow(count, "shard long, path string, n_words long")


def _dealt(buckets: int):
    """The words of each shard by hash bucket, as one packed row each."""

    def deal(parts):
        for part in parts:
            for shard, path in zip(part.column("shard").to_pylist(), part.column("path").to_pylist()):
                held = _load(path, "words", "hashes")
                words = held.column("words")[0].as_py().split(b" ")
                hashes = held.column("hashes").flatten().to_numpy().astype("u8")
                edges = np.searchsorted(hashes * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype="u8"))
                rows = [(b, edges[b], edges[b + 1]) for b in range(buckets) if edges[b] < edges[b + 1]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([b for b, _, _ in rows], "int64"),
                        "shard": pa.array([shard] * len(rows), "int64"),
                        "words": pa.array([zlib.compress(b" ".join(words[i:j]), 1) for _, i, j in rows], pa.binary()),
                    }
                )

    return deal


NUMBERED = "bucket long, shard long, places binary, n_new long, new_words binary"


def _number(parts):
    """Numbers the words of a bucket as they come; new ones stand in the row that has them first."""
    bucket, known = None, {}
    for part in parts:
        rows = []
        for row in part.to_pylist():
            if row["bucket"] != bucket:
                bucket, known = row["bucket"], {}
            words, before = zlib.decompress(row["words"]).split(b" "), len(known)
            places = np.fromiter((known.setdefault(w, len(known)) for w in words), "u4", len(words))
            new = [w for w, p in zip(words, places.tolist()) if p >= before]
            rows.append((bucket, row["shard"], zlib.compress(places.tobytes(), 1), len(new), zlib.compress(b" ".join(new), 1)))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in NUMBERED.split(", ")]
            )


def _named(parts):
    """`word, term_id` from the new words of each row, numbered in their order."""
    for part in parts:
        for start, n, words in zip(*(part.column(c).to_pylist() for c in ("first_id", "n_new", "new_words"))):
            if n:
                found = pa.array(zlib.decompress(words).split(b" "), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([found, pa.array(np.arange(start, start + n))], ["word", "term_id"])


def _recode(parts):
    """Local codes become term ids. Rows come by shard: its path first, then its places by bucket."""
    shard, path, terms = None, None, []

    def row():
        held = _load(path, "docs", "indptr", "codes", "data")
        value = lambda name: held.column(name).flatten().to_numpy(zero_copy_only=False)
        indptr, codes = value("indptr"), value("codes")
        indices = np.concatenate(terms)[codes] if len(codes) else np.empty(0, "i8")
        # Rows of a shard and term ids fit one key.
        key = np.repeat(np.arange(len(indptr) - 1) << 40, np.diff(indptr)) | indices
        order = np.argsort(key)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard], "int64"),
                held.column("docs"),
                held.column("indptr"),
                pa.array([indices[order]], pa.list_(pa.int64())),
                pa.array([value("data")[order]], pa.list_(pa.int32())),
            ],
            ["shard", "docs", "indptr", "indices", "data"],
        )

    for part in parts:
        for one in part.to_pylist():
            if one["path"] is not None:
                if shard is not None:
                    yield row()
                shard, path, terms = one["shard"], one["path"], []
            else:
                terms.append(np.frombuffer(zlib.decompress(one["places"]), "u4").astype("i8") + one["start"])
    if shard is not None:
        yield row()


def document_terms(docs: DataFrame, keys: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The matrix shards and the dictionary of a table of texts.

    Shards are rows `shard, docs, indptr, indices, data`: `docs` has the columns
    `keys` of each document with `digest` (SHA-256 of the text), `chars` (code
    points), `capitals` and `symbols`; the entries of document i are
    `indices[indptr[i]:indptr[i + 1]]` (term ids, ascending) with their counts
    in `data`. The dictionary is `word, term_id` with dense term ids.

    Words are maximal runs of characters other than ASCII blanks. A null text is
    empty, an empty or blank one has an empty row; repeated rows are rows of
    their own, ids may be null or repeat, and an empty table gives no shard and
    no word. Only `keys` and `text` are read, so other columns may have any
    name. Shards hold about 16 MiB of text; a longer text is counted in pieces
    of 4 MiB and is a shard alone.

    Counts stay in files of the shared folder. A shard's words, once each, go
    packed by hash bucket to the task that numbers the bucket, and the numbers
    go back to the shard. Buckets are as many as keep one at about 500,000
    words, and the most frequent word is one word per shard there. Numbers are
    a written table, so a lost executor costs its tasks and no number changes.
    """
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession, "terms")
    _local_shards(docs, keys, text, folder).write.parquet(f"{folder}/shards")
    local = spark.read.parquet(f"{folder}/shards")
    total, shards = local.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-total // BUCKET_WORDS))
    # A shard is a small row, so AQE would put all of them into one task.
    paths = local.where("n_words > 0").select("shard", "path").repartition(max(1, min(shards, MOST_TASKS)), "shard")
    dealt = paths.mapInArrow(_dealt(buckets), "bucket long, shard long, words binary")
    dealt = dealt.repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket", "shard")
    dealt.mapInArrow(_number, NUMBERED).write.parquet(f"{folder}/numbers")
    numbers = spark.read.parquet(f"{folder}/numbers")
    # One row per bucket is ordered here; buckets start one after the other.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbers.groupBy("bucket").agg(F.sum("n_new").alias("n"))
    starts = starts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = numbers.join(starts, "bucket")
    in_bucket = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("start") + F.coalesce(F.sum("n_new").over(in_bucket), F.lit(0))
    named = placed.select("n_new", "new_words", first.alias("first_id"))
    dictionary = named.mapInArrow(_named, "word string, term_id long")

    heads = local.select("shard", F.lit(-1).cast("long").alias("bucket"), "path")
    rows = placed.select("shard", "bucket", "start", "places").unionByName(heads, allowMissingColumns=True)
    fields = docs.select(*keys).schema.simpleString()[len("struct<") : -1]
    facts = ",".join(f"{n}:{'binary' if n == 'digest' else 'long'}" for n in _FACTS)
    gathered = rows.repartition(max(1, min(shards, MOST_TASKS)), "shard").sortWithinPartitions("shard", "bucket")
    matrix = gathered.mapInArrow(
        _recode, f"shard long, docs array<struct<{fields},{facts}>>, indptr array<long>, indices array<long>, data array<int>"
    )
    return matrix, dictionary


def row_sums(shards: DataFrame) -> DataFrame:
    """The columns of `docs` with `n_words` (row sums) and `n_distinct` (entries per row)."""
    fields = shards.schema["docs"].dataType.elementType

    def run(parts):
        for part in parts:
            for n in range(part.num_rows):
                one = part.slice(n, 1)
                indptr = one.column("indptr").flatten().to_numpy()
                total = np.concatenate([[0], np.cumsum(one.column("data").flatten().to_numpy(), dtype="i8")])
                columns = dict(zip(fields.names, one.column("docs").flatten().flatten()))
                columns["n_words"] = pa.array(total[indptr[1:]] - total[indptr[:-1]], "int64")
                columns["n_distinct"] = pa.array(np.diff(indptr), "int64")
                yield pa.RecordBatch.from_pydict(columns)

    return shards.select("docs", "indptr", "data").mapInArrow(
        run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_words long, n_distinct long"
    )


def judged(docs: DataFrame, labels: DataFrame, part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: `doc_id, part, mask, good, toxic`.

    Bit i of `mask` is set when the document fails filter i of ABCDE: A has
    under 200 words, B under 50 % distinct words, C over 2 % capitals, D any of
    the symbols, E the text of a smaller doc_id. Null texts are empty texts, a
    null part is the empty string. Null ids are neither smaller nor larger than
    others, so they fail E never and make none fail; equal ids don't either.
    `good` and `toxic` tell whether any row of `labels` with this id has quality
    or toxic 1; documents without labels and null labels have neither.
    """
    keys = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"), F.col(text).alias("text"))
    shards, _ = document_terms(keys, ["doc_id", "part"])
    facts = cut_lineage(row_sums(shards))
    # Only texts that occur more than once go to the join; AQE splits a hot one.
    copies = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    rows = facts.join(copies.drop("n"), "digest", "left").join(marks, F.col("doc_id") == F.col("label_id"), "left")
    failed = [
        F.col("n_words") < FEWEST_WORDS,
        100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"),
        100 * F.col("capitals") > MOST_CAPITALS * F.col("chars"),
        F.col("symbols") > 0,
        F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)),
    ]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    return rows.select(
        "doc_id", "part", mask.alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def interactions(rows: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """Counts per part for each order of the filters and each step of it.

    `rows` has `part, mask, good, toxic`; a part with a third of all rows is at
    most 2^n rows per task before anything is shuffled, and the list per part
    has at most 2^n entries. Every part gets n! * n rows, zeros included;
    `shapley` sums what the step's filter removes over all n! orders.
    """
    counts = rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))
    orders = ["".join(p) for p in permutations(filters)]
    weights = F.array(*[F.lit(len(orders) // k) for k in range(1, len(filters) + 1)])
    steps = held.select(
        "part", "held", F.explode(F.array(*map(F.lit, orders))).alias("filter_order")
    ).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    letter = F.col("filter_order").substr(F.col("step"), F.lit(1))
    bit_of = lambda c: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), c) - 1)
    # Letters before the step; sequence would count down from 1 to 0, so the step itself is taken off.
    upto = F.aggregate(
        F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda acc, i: acc.bitwiseOR(bit_of(F.col("filter_order").substr(i, F.lit(1))))
    )
    steps = steps.select("*", upto.alias("upto"), bit_of(letter).alias("bit"))
    steps = steps.withColumn("before", F.col("upto") - F.col("bit"))

    def total(test, value=lambda e: e["n"]) -> Column:
        return F.aggregate("held", F.lit(0).cast("long"), lambda acc, e: acc + F.when(test(e["mask"]), value(e)).otherwise(F.lit(0)))

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    there = lambda m: m.bitwiseAND(F.col("before")) == 0
    removed = lambda m: fails(m) & there(m)
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: m.bitwiseAND(F.col("upto")) == 0).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m) & ~there(m)).alias("redundant"),
        total(lambda m: m == F.col("bit")).alias("unique_fails"),
        total(removed, lambda e: e["good"]).alias("good_lost"),
        total(removed, lambda e: e["toxic"]).alias("toxic_lost"),
        # Of the orders, the share 1 / (failed filters) has this filter first among them.
        total(fails, lambda e: e["n"] * F.element_at(weights, F.bit_count(e["mask"]))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`interactions` of the five filters over `docs`; an empty table gives no rows."""
    return interactions(judged(docs, labels, part, doc_id, text))
