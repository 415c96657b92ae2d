"""Fuzzy line deduplication with DataFrame functions only.

Lines are normalised; equal ones are one line. Where the similarity allows one
or two edits, one of three segments of the longer line stays whole in the
other, so lines are joined on segments and no pair is missed. Longer lines are
joined on those of their character n-grams that have the lowest hashes. Pairs
that share two of them are verified by edit similarity. Connected lines are one
group, and the first occurrence of a group stays.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embedlake.llm import batches
from embedlake.llm.components import components
from embedlake.session import work_dir

SIMILARITY = 0.9
# Keys of a line at most, and classes of lines: least characters, characters of an n-gram, keys.
MINIMA = 30
CLASSES = ((0, 5, 30), (30, 10, 30), (60, 12, 24), (150, 15, 30))
# Long lines that are compared share so many keys, or all of one that has fewer.
SHARED = 2
# From so many characters on they lie so far from each other.
LONG, SPREAD = 400, 15
# Hashes that are looked at for one that is kept.
SAMPLE = 1.5
# Low bits of a minimum that are of the hash; those above are the place of its n-gram in the line.
HASH = 48
# Grams that start in one piece of a line, and characters behind the piece that the longest one needs.
PIECE, BEHIND = 16, max(gram for _, gram, _ in CLASSES) - 1
BANDS = [f"m{i}" for i in range(MINIMA)]
# Of so many keys of a line the rows are on disk at the same time, in the mean.
BANDS_AT_ONCE = 6
# So many edits leave one of three segments whole, or one in the middle moved by one.
SEGMENT_EDITS = 2
# A written step leaves no shuffle files behind.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def normalised(text: Column) -> Column:
    """Lower case; runs of ASCII within a line that hold no letter or digit are one blank."""
    return F.regexp_replace(F.lower(text), r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`doc_id, print, at, norm` of all lines with a letter or digit."""
    filled = F.coalesce(F.col(text), F.lit(""))
    # Texts are normalised before they are cut: filters on lines would do it again.
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(filled).alias("print"), F.posexplode(F.split(normalised(filled), "\n")).alias("at", "line")
    )
    return rows.select("doc_id", "print", "at", F.trim("line").alias("norm")).where("norm <> ''")


def _most(length: Column, similarity: float) -> Column:
    """Edits between two lines of which the longer has this length."""
    return F.floor(length * (1 - similarity) + 1e-9).cast("int")


def _grams(lines: DataFrame) -> DataFrame:
    """The lines, without `norm`, once for each n-gram of `gram` characters: `at`, `start`, and 63 bits of its hash as `g`."""
    # Grams are cut from short pieces, as a place in a text is found by counting its characters.
    pieces = F.regexp_extract_all("norm", F.lit(f"(?s)(?=(.{{1,{PIECE + BEHIND}}})).{{1,{PIECE}}}"), 1)
    pieces = lines.select(*[c for c in lines.columns if c != "norm"], F.posexplode(pieces).alias("at", "piece"))
    pieces = pieces.withColumn("starts", F.least(F.lit(PIECE), F.length("piece") - F.col("gram") + 1)).where("starts > 0")
    starts = pieces.withColumn("start", F.explode(F.sequence(F.lit(1), "starts")))
    g = F.shiftrightunsigned(F.xxhash64(F.substring("piece", F.col("start"), F.col("gram"))), 1)
    return starts.withColumn("g", g).drop("piece", "starts")


def _classes(lines: DataFrame, similarity: float) -> DataFrame:
    """The lines once for each class that they (`main`) or longer partners are in, with its `gram` and `kept`."""
    size, fits = F.col("size"), []
    for k, (least, gram, kept) in enumerate(CLASSES):
        below = size < CLASSES[k + 1][0] if k + 1 < len(CLASSES) else F.lit(True)
        entry = F.struct(F.lit(gram).alias("gram"), F.lit(kept).alias("kept"), (size >= least).alias("main"))
        fits.append(F.when((size / similarity + 1 >= least) & below, entry))
    return lines.select("*", F.explode(F.array_compact(F.array(*fits))).alias("class")).select(*lines.columns, "class.*")


def _minima(rows: DataFrame, whole: bool) -> DataFrame:
    """`line, gram, kept, main, found, m0, m1, ...`: the lowest hashes of distinct n-grams, at most `kept`.

    Above HASH bits of the hash stands the place of the n-gram, 0 if it comes twice or too far behind.
    If not `whole`, only the lowest part of the hashes is looked at, where SAMPLE
    times as many are expected, and the first n-gram.
    """
    grams = F.col("size") - F.col("gram") + 1
    limit = F.when(F.lit(whole) | (grams <= SAMPLE * F.col("kept")), F.lit((1 << 63) - 1)).otherwise((2.0**63 * (SAMPLE * F.col("kept") / grams)).cast("long"))
    own = ["line", "gram", "kept", "main"]
    low = _grams(rows.select(*own, "norm", limit.alias("limit"))).where("g < limit or at = 0 and start = 1")
    rank = F.dense_rank().over(Window.partitionBy("line", "gram").orderBy("g"))
    times = F.count("*").over(Window.partitionBy("line", "gram", "g"))
    low = low.select(*own, "g", (F.col("at") * PIECE + F.col("start")).alias("place"), rank.alias("rank")).where("rank <= kept")
    place = F.when((times == 1) & (F.col("place") < 1 << 63 - HASH), F.col("place")).otherwise(0).cast("long")
    m = F.shiftleft(place, HASH).bitwiseOR(F.col("g").bitwiseAND((1 << HASH) - 1))
    low = low.select(*own, "rank", m.alias("m"))
    return low.groupBy(*own).agg(F.max("rank").alias("found"), *[F.min(F.when(F.col("rank") == i + 1, F.col("m"))).alias(b) for i, b in enumerate(BANDS)])


def _segment_keys(similarity: float) -> Column:
    """Keys of a line as the longer of a pair and as one up to two shorter."""
    norm, size = F.col("norm"), F.length("norm")
    keys = []
    for less in range(SEGMENT_EDITS + 1):
        longer = size + less
        most = _most(longer, similarity)
        fits = most.between(max(less, 1), SEGMENT_EDITS)
        a, b = F.floor(longer / 3).cast("int"), F.floor(longer * 2 / 3).cast("int")
        parts = [("head", fits, norm.substr(F.lit(1), a)), ("tail", fits, norm.substr(size - (longer - b) + 1, longer - b))]
        moved = (0, -1, 1)
        parts += [("middle", fits & (most == 2), norm.substr(a + 1 + move, b - a)) for move in moved]
        keys += [F.when(when, F.xxhash64(F.lit(name), longer, part)) for name, when, part in parts]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def _write(df: DataFrame, path: str) -> DataFrame:
    """The rows, written and read again; their shuffles are removed after it."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _remove(spark: SparkSession, *paths: str) -> None:
    """Written steps that nothing reads any more go."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _buckets(lines: DataFrame, similarity: float) -> list[tuple[bool, DataFrame]]:
    """Parts of `line, size, place, key`; near lines share a key. True: of segments.

    Parts go one after the other, so that only the rows of one are on disk at once.
    """
    short = lines.where(_most(F.length("norm"), similarity) <= SEGMENT_EDITS).select("line", "size", "norm").distinct()
    parts = [(True, short.select("line", "size", F.lit(0).alias("place"), F.explode(_segment_keys(similarity)).alias("key")))]
    turns = MINIMA // BANDS_AT_ONCE
    keys = lines.select("line", "size", F.explode(F.array(*BANDS)).alias("m")).where("m is not null")
    place, low = F.shiftright("m", HASH).cast("int"), F.col("m").bitwiseAND((1 << HASH) - 1)
    keys = keys.select("line", "size", place.alias("place"), low.alias("low"))
    for turn in range(turns):
        parts.append((False, keys.where(F.pmod("low", F.lit(turns)) == turn).select("line", "size", "place", F.xxhash64("low").alias("key"))))
    return parts


def _mates(rows: DataFrame, similarity: float) -> DataFrame:
    """`line, key, place, mate` of the buckets that hold more than one line.

    The mate is the line before in the bucket or else the smallest, if its length and place fit.
    """
    dealt = rows.repartition("key")
    shared = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    # Running frames: a bucket streams through its task, nothing is gathered.
    order = Window.partitionBy("key").orderBy("line")
    mate = F.struct("line", "size", "place")
    met = dealt.join(shared.hint("shuffle_hash"), "key", "left_semi")
    met = met.select("*", F.lag(mate).over(order).alias("prev"), F.first(mate).over(order).alias("head"))
    near = [F.when(_placed("size", f"{m}.size", "place", f"{m}.place", similarity), F.col(f"{m}.line")) for m in ("prev", "head")]
    return met.select("line", "key", "place", F.when(F.col("prev").isNotNull(), F.coalesce(*near)).alias("mate"))


def _verified(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """The `a, b` pairs whose lines are similar by edit distance."""
    joined = pairs.join(lines.select(F.col("line").alias("a"), F.col("norm").alias("p"), F.col("size").alias("m")), "a")
    joined = joined.join(lines.select(F.col("line").alias("b"), F.col("norm").alias("q"), F.col("size").alias("n")), "b")
    joined = joined.where(_sized(F.col("m"), F.col("n"), similarity)).withColumn("most", _most(F.greatest("m", "n"), similarity))
    # A narrow band is much cheaper, and most similar lines differ little.
    return joined.where("levenshtein(p, q, most div 8 + 1) >= 0 or levenshtein(p, q, most) >= 0").select("a", "b")


def _sized(x: Column, y: Column, similarity: float) -> Column:
    """Are lines of these lengths near enough in length?"""
    return F.abs(x - y) <= _most(F.greatest(x, y), similarity)


def _placed(x: str, y: str, at: str, on: str, similarity: float) -> Column:
    """Are lines of these lengths near enough in length, and what they share in its places (0 is any)?

    What edits leave alone is moved by one place by each at most.
    """
    apart = F.abs(F.col(at) - F.col(on)) <= _most(F.greatest(x, y), similarity)
    return _sized(F.col(x), F.col(y), similarity) & ((F.col(at) == 0) | (F.col(on) == 0) | apart)


def _spread(place: str) -> Column:
    """Do these places lie apart by an n-gram, or is one not known?"""
    return (F.min(place) == 0) | (F.max(place) - F.min(place) >= SPREAD)


def _class(size: str, similarity: float) -> Column:
    """Lengths in steps a little wider than those that near lines may differ by."""
    return F.floor(F.log(F.col(size)) / (1.001 * -math.log(similarity))).cast("int")


def line_groups(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`line, group`: distinct normalised lines connected by near duplicates.

    `line` is a 64-bit key, `group` the smallest key reached. Pairs of edit
    similarity `similarity` connect, lines without a partner are not listed.
    All pairs of at most SEGMENT_EDITS edits by their length are found; of
    longer lines those that share SHARED kept n-grams, see README for the recall.

    Inside a bucket every line first meets the smallest line and the one before
    it, and is compared with the one it meets most often. Only lines of a bucket
    that are not connected by then are compared with each other, so nothing in
    a bucket is lost.
    """
    spark = docs.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return _connected(docs, similarity, doc_id, text, work_dir(spark, "fuzzy_lines"))
    finally:
        spark.conf.set(CLEANUP, before)


def _connected(docs: DataFrame, similarity: float, doc_id: str, text: str, folder: str) -> DataFrame:
    spark = docs.sparkSession
    # Equal lines meet as one row per task before the shuffle.
    keyed = _lines(docs, doc_id, text).select(F.xxhash64("norm").alias("line"), "norm")
    # Shorter lines have no partner that differs.
    able = _most(F.length("norm") / similarity + 1, similarity) > 0
    distinct = keyed.where(able).groupBy("line").agg(F.max("norm").alias("norm"))
    sized = distinct.withColumn("size", F.length("norm"))
    # The longest partner of a line has at most size / similarity characters.
    long = sized.where(_most(F.col("size") / similarity + 1, similarity) > SEGMENT_EDITS)
    every = sized.join(_minima(_classes(long, similarity), False), "line", "left")
    sampled = _write(every.withColumn("main", F.coalesce("main", F.lit(True))), f"{folder}/sampled")
    # Lines of few different grams, or with few low hashes, are looked at as a whole.
    few = F.coalesce((F.col("found") < F.col("kept")) & (F.col("size") - F.col("gram") + 1 > SAMPLE * F.col("kept")), F.lit(False))
    rest = sampled.where(few).drop("found", *BANDS)
    whole = _write(rest.join(_minima(rest, True), ["line", "gram", "kept", "main"]), f"{folder}/whole")
    every = sampled.where(~few).unionByName(whole)
    lines = every.where("main").select("line", "norm", "size", F.coalesce("found", F.lit(SHARED)).alias("found"))

    parts = _buckets(every, similarity)
    met = [_write(_mates(rows, similarity), f"{folder}/met/{k}") for k, (_, rows) in enumerate(parts)]
    # A shared segment is enough.
    mates = [df.select("line", "mate", "place", F.lit(SHARED if exact else 1).alias("n")) for (exact, _), df in zip(parts, met)]
    mates = reduce(DataFrame.union, mates).where("mate is not null").groupBy("line", "mate").agg(F.sum("n").alias("n"), _spread("place").alias("spread"))
    mates = mates.where((F.col("n") >= SHARED) & F.col("spread"))
    # The mate that a line meets most often comes first.
    mates = mates.groupBy("line").agg(F.max(F.struct("n", "mate")).alias("most"))
    first = _write(mates.select(F.col("most.mate").alias("a"), F.col("line").alias("b")), f"{folder}/first")
    edges = _write(_verified(first, lines, similarity), f"{folder}/edges")
    named = _write(components(edges, small=0), f"{folder}/named")

    # Buckets that hold several components by then.
    known = lines.select("line", "size", "found").join(named.withColumnRenamed("node", "line"), "line", "left")
    known = known.withColumn("component", F.coalesce("component", "line"))
    for k, (exact, _) in enumerate(parts):
        slim = met[k].select("line", "key", "place").join(known, "line")
        split = slim.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        apart = slim.join(split.select("key"), "key", "left_semi")
        # Lines near in length are of one class or the next: they meet in the larger one.
        apart = apart.withColumn("class", _class("size", similarity)).withColumn("at", F.explode(F.array("class", F.col("class") + 1)))
        sides = [apart.select("key", "at", *[F.col(c).alias(f"{c}_{x}") for c in ("line", "size", "place", "found", "component", "class")]) for x in "ab"]
        rest = sides[0].join(sides[1], ["key", "at"]).where("line_a < line_b and component_a <> component_b and at = greatest(class_a, class_b)")
        rest = rest.where(_placed("size_a", "size_b", "place_a", "place_b", similarity))
        need = F.least(F.lit(0 if exact else SHARED), "found_a", "found_b")
        place = F.when(F.greatest("size_a", "size_b") >= LONG, F.col("place_a")).otherwise(0)
        rest.select(F.col("line_a").alias("a"), F.col("line_b").alias("b"), need.alias("need"), place.alias("place")).write.parquet(f"{folder}/rest/part={k}")
        _remove(spark, f"{folder}/met/{k}")
    rest = spark.read.parquet(f"{folder}/rest")
    rest = rest.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("need").alias("need"), _spread("place").alias("spread"))
    rest = _write(rest.where(f"n >= need and (spread or need < {SHARED})").select("a", "b", "n"), f"{folder}/pairs")
    _remove(spark, f"{folder}/rest")
    for turn in ("one", "all"):
        # Of two components the pair that shares most comes first, and often leaves nothing to do for the others.
        nodes = [named.select(F.col("node").alias(x), F.col("component").alias(f"{x}_in")) for x in "ab"]
        apart = rest.join(nodes[0], "a", "left").join(nodes[1], "b", "left").withColumns({f"{x}_in": F.coalesce(f"{x}_in", x) for x in "ab"}).where("a_in <> b_in")
        if turn == "one":
            ends = [F.least("a_in", "b_in").alias("low"), F.greatest("a_in", "b_in").alias("high")]
            apart = apart.groupBy(*ends).agg(F.max(F.struct("n", "a", "b")).alias("most")).select("most.*")
        apart = _write(apart.select("a", "b"), f"{folder}/apart/{turn}")
        # Texts meet for half as many pairs at once as there are lines.
        steps = 2 * apart.count() // (lines.count() + 1) + 1
        for k in range(steps):
            step = apart.where(F.pmod(F.xxhash64("a", "b"), F.lit(steps)) == k)
            _verified(step, lines, similarity).write.parquet(f"{folder}/more/{turn}/step={k}")
        more = spark.read.parquet(f"{folder}/more/{turn}").select("a", "b")
        if not more.isEmpty():
            stars = named.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
            named = _write(components(stars.union(more), small=0), f"{folder}/joined/{turn}")
    _remove(spark, *[f"{folder}/{step}" for step in ("sampled", "whole", "first", "edges", "pairs", "apart", "more")])
    return named.select(F.col("node").alias("line"), F.col("component").alias("group"))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`doc_id, print, dropped`: positions of the lines that go, per document.

    `print` is xxhash64 of the text (empty for null). Of each group of near
    duplicate lines the first occurrence stays, by doc_id (null last), print
    and position. Lines without a letter or digit are left alone. Rows of equal
    doc_id and text are one document. Documents that lose nothing, empty texts
    and empty tables give no rows.
    """
    named = line_groups(docs, doc_id=doc_id, text=text, **options)
    lines = _lines(docs, doc_id, text).select(
        "doc_id", "print", "at", F.xxhash64("norm").alias("line"), F.xxhash64(F.lit(1), "norm").alias("check")
    )
    # Equal lines are told by 128 bits, near ones by their group.
    grouped = lines.join(named, "line", "left").select(
        "doc_id", "print", "at", F.coalesce("group", "line").alias("group"), F.when(F.col("group").isNull(), F.col("check")).alias("check")
    )
    grouped = grouped.withColumn("check", F.coalesce("check", F.lit(0).cast("long")))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "print", "at").alias("place")
    firsts = grouped.groupBy("group", "check").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = grouped.join(firsts, ["group", "check"]).where(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("print") == F.col("first.print")) & (F.col("at") == F.col("first.at")))
    )
    return later.groupBy("doc_id", "print").agg(F.array_sort(F.collect_set("at")).alias("dropped"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with the later near-duplicate lines cut out of the text.

    All columns are kept. A document left without any letter or digit goes if
    it had one before; one that had none stays as it is.
    """
    gone = repeated_lines(docs, doc_id, text, **options).withColumnsRenamed({"doc_id": "gone_id", "print": "gone_print"})
    rows = docs.select(batches.packed(docs), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("print", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("print") == F.col("gone_print"))
    joined = rows.join(gone, same, "left")
    lines = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("dropped", i))
    rest = joined.withColumn("rest", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")))
    kept = rest.where(F.col("dropped").isNull() | F.col("rest").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))
    return batches.unpacked(kept, docs.columns, **{text: F.col("rest")})
