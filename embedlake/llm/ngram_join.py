"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is its set of word shingles. Sets are brought together with the
corpus frequency of every shingle; shingles are ordered by frequency, so those
of one document alone come first and never make a candidate. With a similarity
of t, a set of n shingles overlaps any partner in at least o = ceil(t * n), so
partners share at least one of its first n - o + 1 shingles, and at least l of
its first n - o + l. Each document takes the l whose prefix has the smallest
estimated cost, and a pair is verified only if its prefixes share the smaller
l of both. Documents whose prefixes touch form candidate groups, and verifying
a group needs each set once, not once per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.llm import batches
from embedlake.llm.components import components
from embedlake.llm.words import Texts, Words, mix, not_blank
from embedlake.session import cut_lineage

SHINGLE, PERCENT = 5, 75
LONGEST_MATCH = 4
# Shingles of one reduce group and sets of one verification block, on average.
GROUP, BLOCK = 1 << 21, 1024
SLICE = 6 << 20
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def _sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, document) pairs in shingle order; set keys and sizes."""
    words = Words(Texts(texts), not_blank(), lower=True)
    at, hashes = words.windows(size)
    docs = np.searchsorted(words.first, at, "right") - 1
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        whole = [_fold(words.hashes[words.first[i] : words.first[i + 1]]) for i in short]
        hashes = np.concatenate([hashes, mix(np.concatenate(whole))])
        docs = np.concatenate([docs, short])
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[fresh], docs[fresh]
    keys = np.zeros(len(texts), "u8")
    np.add.at(keys, docs, mix(hashes ^ _OTHER))
    return hashes, docs, keys, np.bincount(docs, minlength=len(texts))


def _fold(hashes: np.ndarray) -> np.ndarray:
    total = np.array([len(hashes)], "u8")
    for h in hashes:
        total = total * np.uint64(0x9E3779B97F4A7C15) + h
    return total


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """`doc_id, print, set_key, n_shingles`: a 64-bit key of each document's shingle set."""

    def run(parts):
        for part in batches.slices(parts):
            _, _, keys, sizes = _sets(batches.raw_texts(part), size)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("print"), pa.array(keys.view("i8")), pa.array(sizes, "int64")],
                ["doc_id", "print", "set_key", "n_shingles"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, print long, set_key long, n_shingles long")


def _planes(values: np.ndarray) -> bytes:
    """Bytes by place, so that the even high bytes of sorted values compress."""
    return values.astype("<u8").view("u1").reshape(-1, 8).T.tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, "u1").reshape(8, -1).T.copy().view("<u8").reshape(-1)


def _postings(docs: DataFrame, size: int, groups: int) -> DataFrame:
    """Sorted runs of (shingle, set) pairs, cut into ranges of shingles."""

    def run(parts):
        for part in batches.slices(parts, limit=SLICE):
            hashes, at, keys, sizes = _sets(batches.raw_texts(part), size)
            every, first = np.unique(keys, return_index=True)
            once = np.zeros(len(keys), bool)
            once[first] = True
            keep = once[at]
            hashes, at = hashes[keep], at[keep]
            ranges = ((hashes >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
            cuts = np.searchsorted(ranges, np.arange(groups + 1, dtype="u8"))
            rows = {"bucket": [], "shingles": [], "places": [], "sets": [], "sizes": []}
            for b in np.flatnonzero(np.diff(cuts)):
                own = slice(cuts[b], cuts[b + 1])
                used, place = np.unique(at[own], return_inverse=True)
                rows["bucket"].append(int(b))
                rows["shingles"].append(_planes(hashes[own]))
                rows["places"].append(place.astype("<u4").view("u1").reshape(-1, 4).T.tobytes())
                rows["sets"].append(keys[used].tobytes())
                rows["sizes"].append(sizes[used].astype("<u4").tobytes())
            blobs = {k: pa.array(v, "binary") for k, v in rows.items() if k != "bucket"}
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(rows["bucket"], "int64"), **blobs})

    return docs.select("text").mapInArrow(run, "bucket long, shingles binary, places binary, sets binary, sizes binary")


def _shared(table: pa.Table, targets: int) -> pa.Table:
    """Of one range: the shingles of two or more sets with their frequency, dealt out by set."""
    hashes, sets, sizes = [], [], []
    for shingles, places, keys, counts in zip(*(table.column(c).to_pylist() for c in ("shingles", "places", "sets", "sizes"))):
        hashes.append(_values(shingles))
        place = np.frombuffer(places, "u1").reshape(4, -1).T.copy().view("<u4").reshape(-1)
        sets.append(np.frombuffer(keys, "<u8")[place])
        sizes.append(np.frombuffer(counts, "<u4")[place])
    hashes, sets, sizes = (np.concatenate(x) for x in (hashes, sets, sizes))
    order = np.lexsort((sets, hashes))
    hashes, sets, sizes = hashes[order], sets[order], sizes[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (sets[1:] != sets[:-1])
    hashes, sets, sizes = hashes[fresh], sets[fresh], sizes[fresh]
    runs = np.diff(np.append(np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])), len(hashes)))
    often = np.repeat(runs, runs)
    keep = often > 1
    hashes, sets, sizes, often = hashes[keep], sets[keep], sizes[keep], often[keep]
    target = ((mix(sets) >> np.uint64(32)) * np.uint64(targets)) >> np.uint64(32)
    order = np.lexsort((hashes, sets, target))
    hashes, sets, sizes, often, target = (x[order] for x in (hashes, sets, sizes, often, target))
    cuts = np.searchsorted(target, np.arange(targets + 1, dtype="u8"))
    rows = {"target": [], "sets": [], "sizes": [], "runs": [], "shingles": [], "often": []}
    for t in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[t], cuts[t + 1])
        keys, first, counts = np.unique(sets[own], return_index=True, return_counts=True)
        rows["target"].append(int(t))
        rows["sets"].append(keys.tobytes())
        rows["sizes"].append(sizes[own][first].tobytes())
        rows["runs"].append(counts.astype("<u4").tobytes())
        rows["shingles"].append(hashes[own].tobytes())
        rows["often"].append(often[own].astype("<u4").tobytes())
    return pa.table({k: pa.array(v, "int64" if k == "target" else "binary") for k, v in rows.items()})


def _records(table: pa.Table, percent: int) -> pa.Table:
    """The sets of one share that can have a partner, with their prefixes."""
    columns = ("sets", "sizes", "runs", "shingles", "often")
    parts = [
        [np.frombuffer(x, kind) for x, kind in zip(row, ("<u8", "<u4", "<u4", "<u8", "<u4"))]
        for row in zip(*(table.column(c).to_pylist() for c in columns))
    ]
    keys, sizes, runs, hashes, often = (np.concatenate(x) for x in zip(*parts))
    sets, sizes = np.repeat(keys, runs), np.repeat(sizes, runs)
    order = np.lexsort((hashes, often, sets))
    sets, sizes, hashes, often = sets[order], sizes[order].astype("i8"), hashes[order].view("i8"), often[order].astype("i8")
    first = np.flatnonzero(np.append(True, sets[1:] != sets[:-1]))
    shared = np.diff(np.append(first, len(sets)))
    rows = {"set_key": [], "n": [], "match": [], "length": [], "shingles": []}
    for at, k in zip(first, shared):
        n = int(sizes[at])
        if 100 * k < percent * n:
            continue
        match, length = choose_match(n, (percent * n + 99) // 100, often[at : at + k], n - int(k))
        if length:
            for name, value in zip(rows, (int(sets[at : at + 1].view("i8")[0]), n, match, length, hashes[at : at + k])):
                rows[name].append(value)
    kinds = {"shingles": pa.list_(pa.int64())}
    return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()})


def choose_match(n: int, overlap: int, often: np.ndarray, alone: int, longest: int = LONGEST_MATCH) -> tuple[int, int]:
    """The number of prefix shingles a partner must share, and the length of the
    prefix among the shared shingles, of least estimated cost.

    Reading a list of f documents costs f; by Markov's bound at most
    sum(f) / l of them share l shingles, and each of those costs a merge of n.
    """
    best = None
    for match in range(1, min(longest, overlap) + 1):
        length = max(0, n - overlap + match - alone)
        read = float((often[:length] - 1).sum())
        cost = read + read / match * n / 16
        if best is None or cost < best[0]:
            best = (cost, match, length)
    return best[1], best[2]


def records(docs: DataFrame, size: int, percent: int, groups: int, targets: int) -> DataFrame:
    """`set_key, n, match, length, shingles` of the sets that can have a partner.

    Shingles are those of two or more sets, rarest first; a set with fewer of
    them than the overlap it needs has no partner and is left out.
    """
    shared = _postings(docs, size, groups).groupBy("bucket").applyInArrow(
        lambda t: _shared(t, targets), "target long, sets binary, sizes binary, runs binary, shingles binary, often binary"
    )
    return shared.groupBy("target").applyInArrow(
        lambda t: _records(t, percent), "set_key long, n long, match long, length long, shingles array<bigint>"
    )


class _Forest:
    """Union-find on positions, with the root of every position at hand."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> np.ndarray:
        """Join others to a; returns one of each group that was apart."""
        apart = np.unique(self.root[others[self.root[others] != self.root[a]]])
        self.root[np.isin(self.root, apart)] = self.root[a]
        return apart


def link(
    sizes: np.ndarray, matches: np.ndarray, prefixes: list[np.ndarray], shingles: list[np.ndarray],
    percent: int, side: np.ndarray | None = None, groups: np.ndarray | None = None,
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect what the pairs of similarity `percent` connect, and the roots.

    Pairs already connected are not verified. With `side`, only pairs of
    different sides are looked at; with `groups`, sets of one group are
    connected from the start.
    """
    n = len(sizes)
    lengths = np.array([len(s) for s in shingles])
    every, place = np.unique(np.concatenate(shingles), return_inverse=True)
    owner = np.repeat(np.arange(n), lengths)
    begin = np.cumsum(lengths) - lengths
    in_prefix = np.arange(len(owner)) - begin[owner] < np.array([len(p) for p in prefixes])[owner]

    def lists(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(place[flags], kind="stable")
        cuts = np.searchsorted(place[flags][order], np.arange(len(every) + 1))
        return owner[flags][order], cuts

    members, cuts = lists(in_prefix)
    forest, found = _Forest(n), []
    if groups is not None:
        _, where = np.unique(groups, return_index=True)
        forest.root = where[np.unique(groups, return_inverse=True)[1]]
    sets = [place[begin[i] : begin[i] + lengths[i]] for i in range(n)]
    mark = np.zeros(len(every), bool)
    for x in range(n):
        open_ = (forest.root != forest.root[x]) & (100 * sizes >= percent * sizes[x]) & (100 * sizes[x] >= percent * sizes)
        if side is not None:
            open_ &= side != side[x]
        else:
            open_[:x] = False
        if not open_.any():
            continue
        tokens = sets[x][: len(prefixes[x])]
        met = np.concatenate([members[cuts[t] : cuts[t + 1]] for t in tokens]) if len(tokens) else members[:0]
        shared = np.bincount(met, minlength=n)
        near = np.flatnonzero(open_ & (shared >= np.minimum(matches, matches[x])))
        mark[sets[x]] = True
        for y in near[np.argsort(-shared[near], kind="stable")]:
            if forest.root[y] == forest.root[x]:
                continue
            common = int(np.count_nonzero(mark[sets[y]]))
            if 100 * common >= percent * (int(sizes[x]) + int(sizes[y]) - common):
                found.append((x, int(y)))
                forest.join(x, np.array([y]))
        mark[sets[x]] = False
    return found, forest.root


def _linked(table: pa.Table, percent: int, sided: bool) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    keys = table.column("set_key").to_numpy()
    order = np.argsort(keys)
    shingles = table.column("shingles").combine_chunks()
    values, cuts = shingles.values.to_numpy(), shingles.offsets.to_numpy()
    own = [values[cuts[i] : cuts[i + 1]] for i in order]
    n, match, length = (table.column(c).to_numpy()[order] for c in ("n", "match", "length"))
    side, groups = (table.column(c).to_numpy()[order] if sided else None for c in ("side", "cluster"))
    found, root = link(n, match, [s[:k] for s, k in zip(own, length)], own, percent, side, groups)
    return keys[order], found, root, groups


def _label_table(table: pa.Table, percent: int) -> pa.Table:
    """Each set of a block with the smallest key it is connected to inside the block."""
    keys, _, root, _ = _linked(table, percent, False)
    low = np.full(len(keys), np.iinfo("i8").max)
    np.minimum.at(low, root, keys)
    return pa.table({"set_key": pa.array(keys), "cluster": pa.array(low[root])})


def _edge_table(table: pa.Table, percent: int) -> pa.Table:
    """Links between the clusters of two blocks."""
    _, found, _, groups = _linked(table, percent, True)
    return pa.table({"a": pa.array([groups[x] for x, _ in found], "int64"), "b": pa.array([groups[y] for _, y in found], "int64")})


def _blocks(rows: DataFrame, group: str, block: int) -> DataFrame:
    """Add `blocks` (of the row's group) and `block`; a block holds about `block` rows."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    placed = F.pmod(F.xxhash64("set_key", F.lit("block")), F.col("blocks"))
    return rows.join(sizes, group).withColumn("block", placed)


def clusters(sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """`set_key, cluster`: the sets connected by pairs of similarity `percent`.

    Sets whose prefixes share a shingle are one candidate group. A group is
    verified in blocks. For a group of several blocks, first every block by
    itself, then one set of each cluster found, and then the sets outside the
    group's largest cluster, in blocks, against all blocks: pairs inside one
    cluster are connected already. So no task holds more than two blocks, and
    only sets that really stay apart cost a product of blocks.
    """
    lists = sets.select("set_key", F.explode(F.slice("shingles", F.lit(1), F.col("length").cast("int"))).alias("shingle"))
    heads = lists.groupBy("shingle").agg(F.min("set_key").alias("head"))
    touching = lists.join(heads, "shingle").where("set_key <> head").select(F.col("set_key").alias("a"), F.col("head").alias("b"))
    groups = components(touching).select(F.col("node").alias("set_key"), F.col("component").alias("candidates"))
    placed = cut_lineage(_blocks(sets.join(groups, "set_key"), "candidates", block))

    def labels(rows: DataFrame) -> DataFrame:
        return rows.groupBy("candidates", "block").applyInArrow(lambda t: _label_table(t, percent), "set_key long, cluster long")

    found = cut_lineage(labels(placed))
    large = placed.where("blocks > 1")
    if large.isEmpty():
        return found

    # One set for each cluster of a block; together they are few, but blocks
    # again if they are not.
    heads = large.join(found.where("cluster = set_key").select("set_key"), "set_key").drop("blocks", "block")
    renamed = labels(_blocks(heads, "candidates", block)).select(F.col("set_key").alias("cluster"), F.col("cluster").alias("wider"))
    found = found.join(renamed, "cluster", "left").select("set_key", F.coalesce("wider", "cluster").alias("cluster"))
    found = cut_lineage(found)

    rows = cut_lineage(large.join(found, "set_key"))
    counted = rows.groupBy("candidates", "cluster").agg(F.count("*").alias("n_sets"))
    largest = counted.groupBy("candidates").agg(F.max(F.struct("n_sets", "cluster")).alias("top")).select(
        "candidates", F.col("top.cluster").alias("largest")
    )
    rest = rows.join(largest, "candidates").where("cluster <> largest").drop("largest", "block")
    rest = rest.withColumnRenamed("blocks", "all_blocks")
    rest = _blocks(rest, "candidates", block).withColumnsRenamed({"block": "rest_block", "blocks": "rest_blocks"})
    # Left over sets go to every block of their group; every block meets every
    # block of left over sets.
    spans = rest.groupBy("candidates").agg(F.max("rest_blocks").alias("rest_blocks"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rest.withColumn("block", numbers("all_blocks"))
    right = rows.join(spans, "candidates").withColumn("rest_block", numbers("rest_blocks"))
    columns = ["candidates", "block", "rest_block", "set_key", "n", "match", "length", "shingles", "cluster"]
    both = left.select(*columns, F.lit(0).cast("long").alias("side")).union(
        right.select(*columns, F.lit(1).cast("long").alias("side"))
    )
    edges = both.groupBy("candidates", "block", "rest_block").applyInArrow(lambda t: _edge_table(t, percent), "a long, b long")
    wider = components(edges).withColumnsRenamed({"node": "cluster", "component": "wider"})
    return found.join(wider, "cluster", "left").select("set_key", F.coalesce("wider", "cluster").alias("cluster"))


def similar_groups(
    docs: DataFrame,
    size: int = SHINGLE,
    percent: int = PERCENT,
    doc_id: str = "doc_id",
    text: str = "text",
    group: int = GROUP,
    block: int = BLOCK,
) -> DataFrame:
    """`doc_id, n_shingles, component_id, print`, one row per input row.

    Two documents link when 100 * |A and B| >= percent * |A or B| over their
    distinct shingles of `size` words (one shingle of all words if there are
    fewer); words are non-blank runs, A-Z in lower case. `component_id` is the
    smallest doc_id reachable. Null and empty texts, and texts of blanks, have
    0 shingles and are alone. Documents of equal sets, repeated rows included,
    are one set; `print` is xxhash64 of the text (empty for null). A null doc_id takes part; a component of nulls only has a null
    id. An empty table gives no rows.

    `group` and `block` set how much one task holds, not what is found. A
    reduce group also holds every set of its most frequent shingle.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("print", F.xxhash64(F.coalesce("text", F.lit(""))))
    held = cut_lineage(signatures(rows, size))
    total = held.agg(F.sum("n_shingles")).first()[0]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(partitions, (total or 0) // group + 1)
    classes = held.where("n_shingles > 0").groupBy("set_key", "n_shingles").agg(F.min("doc_id").alias("lowest"))
    classes = cut_lineage(classes)
    candidates = cut_lineage(records(rows, size, percent, groups, max(partitions, groups // 8)))
    named = clusters(candidates, percent, block)
    joined = classes.join(named, "set_key", "left").withColumn("component", F.coalesce("cluster", "set_key"))
    lowest = joined.groupBy("component").agg(F.min("lowest").alias("component_id"))
    ids = joined.join(lowest, "component").select("set_key", "n_shingles", "component_id")
    columns = ["doc_id", "n_shingles", "component_id", "print"]
    found = held.where("n_shingles > 0").join(ids, ["set_key", "n_shingles"]).select(columns)
    alone = held.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).select(columns)
    return found.unionAll(alone)


def keep_first(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` for each group of similar documents, all columns kept.

    The row with the smallest doc_id stays; of rows that share it, that with the
    smallest print, and of repeated rows one. A null doc_id goes if its group
    has an id; groups of nulls only stay as they are.
    """
    groups = cut_lineage(similar_groups(docs, size, percent, doc_id, text))
    first = F.col("doc_id") == F.col("component_id")
    # Two groups can hold the same doc_id only if the id repeats.
    stays = groups.where(first).groupBy("component_id").agg(F.min("print").alias("stays"))
    ranked = groups.join(stays, "component_id", "left")
    keeps = F.coalesce(first & (F.col("print") == F.col("stays")), F.col("component_id").isNull())
    gone = ranked.where(~keeps).select(F.col("doc_id").alias("gone_id"), F.col("print").alias("gone_print")).distinct()
    rows = docs.select(
        batches.packed(docs), F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print")
    )
    kept = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("print") == F.col("gone_print")), "left_anti")
    again = ranked.where(keeps & first).groupBy("doc_id", "print").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():
        # Only rows that repeat are gathered by their id to drop all but one.
        keys = again.select("doc_id", "print")
        once = kept.join(keys, ["doc_id", "print"], "left_semi").dropDuplicates(["doc_id", "print"])
        kept = kept.join(keys, ["doc_id", "print"], "left_anti").unionByName(once.select("row", "doc_id", "print"), allowMissingColumns=True)
    return batches.unpacked(kept, docs.columns)
