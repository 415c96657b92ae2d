"""Cheapest repair of the structure of conversations by branch and bound.

A conversation's rows are read in order as they come from a range partition, so
one of any length is spread over tasks. Each run of rows is solved depth first
for the states it can begin and end in; runs of one conversation are then put
together by their costs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.session import work_dir

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# What has been put out so far: nothing, a system turn, a user turn, an answer.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
TAKES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
# Cost and edits from a state to a legal end, and an end in one state as it is.
CLOSING = {NOTHING: (0, ""), SYSTEM: (6, "II"), USER: (3, "I"), ASSISTANT: (0, "")}
# From any state another one after a turn is at most two insertions away.
FARTHEST = 2 * INSERT
NO_WAY = 1 << 60

# Rows and bytes of text of one run; a longer conversation is several runs.
RUN_ROWS, RUN_BYTES = 400, 4 << 20
BLANKS = " \t\n\x0b\f\r"

Found = tuple[int, str]


def _bounds(rows: list[tuple[int, str, int]], tail: int, goals: dict[int, Found]) -> list[list[int]]:
    """For every row and state the least that it and the rows after it can cost.

    What a goal adds is left out, so this never exceeds the true cost; from a
    state without a way to any goal it is at least NO_WAY.
    """
    out = [[0 if s in goals else NO_WAY for s in range(4)]] * (len(rows) + 1)
    after = DELETE * tail
    for i in range(len(rows) - 1, -1, -1):
        lead, letter, extra = rows[i]
        then = out[i + 1]
        now = []
        for state in range(4):
            least = min(DELETE + then[state], REROLE + extra + then[NEXT[state]])
            if letter in TAKES[state]:
                least = min(least, extra + then[TAKES[state][letter]])
            now.append(least + after)
        # Two insertions come back to the same turn, so one at a time is enough.
        for state in (ASSISTANT, USER, SYSTEM, NOTHING, USER, ASSISTANT):
            now[state] = min(now[state], INSERT + now[NEXT[state]])
        out[i] = now
        after = DELETE * lead
    return out


def search(rows: list[tuple[int, str, int]], tail: int, start: int, goals: dict[int, Found]) -> Found | None:
    """The least (cost, audit) from `start` to one of `goals`, or None.

    A row is (deletions that must come before it, role initial, cost of leaving
    it in); `tail` deletions must come after the last one. Required deletions
    precede insertions at the same place, because D < I at the same cost.
    """
    n = len(rows)
    must = [lead for lead, _, _ in rows] + [tail]
    bounds = _bounds(rows, tail, goals)
    best: Found | None = None
    table: list[list[Found | None]] = [[None] * 4 for _ in range(n + 1)]
    least = [1 << 62] * (n + 1)

    def hopeless(i: int, state: int, cost: int, audit: str) -> bool:
        total = cost + bounds[i][state]
        if total >= NO_WAY:
            return True
        return best is not None and (total > best[0] or total == best[0] and audit > best[1][: len(audit)])

    first = (0, start, DELETE * must[0], "D" * must[0])
    table[0][start] = first[2:]
    stack = [first]
    while stack:
        i, state, cost, audit = stack.pop()
        if table[i][state] != (cost, audit) or hopeless(i, state, cost, audit):
            continue
        if i == n:
            if state in goals:
                found = (cost + goals[state][0], audit + goals[state][1])
                best = found if best is None else min(best, found)
            continue
        _, letter, extra = rows[i]
        forced, lead = DELETE * must[i + 1], "D" * must[i + 1]
        to = NEXT[state]
        ways = [
            (i, to, cost + INSERT, audit + "I"),
            (i + 1, state, cost + DELETE + forced, audit + "D" + lead),
            (i + 1, to, cost + REROLE + extra + forced, audit + "R" + lead),
        ]
        if letter in TAKES[state]:
            ways.append((i + 1, TAKES[state][letter], cost + extra + forced, audit + "K" + lead))
        # The last one pushed is tried first: the most promising, then the least edit.
        ways.sort(key=lambda w: (w[2] + bounds[w[0]][w[1]], w[3]), reverse=True)
        for way in ways:
            j, held, cost, audit = way
            old = table[j][held]
            if old is not None and old <= (cost, audit) or held >= USER and cost > least[j] + FARTHEST or hopeless(*way):
                continue
            table[j][held] = (cost, audit)
            least[j] = min(least[j], cost)
            stack.append(way)
    return best


class Run:
    """Rows of one conversation that follow each other in one task."""

    def __init__(self):
        self.rows: list[tuple[int, str, int]] = []
        self.waiting = 0  # required deletions since the last free row
        self.free: list[tuple[str, str]] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = self.bytes = 0
        self.first = self.last = None
        self.low = self.high = self.first_turn = self.last_turn = None

    def add(self, turn: int | None, role: str, text: str, copies: int, new: bool) -> None:
        letter, shown = role[:1], text.rstrip(BLANKS)
        if self.last is not None and self.last + letter not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1
        self.first, self.last = letter if self.first is None else self.first, letter
        if turn is not None:
            if self.last_turn != turn:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
            self.first_turn, self.last_turn = self.low, turn
        if not shown:
            self.faults["blank"] += copies
            self.waiting += copies
            return
        again = copies - 1 if new else copies
        self.faults["duplicate"] += again
        if new:
            cut = shown[-1] not in ".!?"
            self.faults["truncated"] += cut
            self.rows.append((self.waiting, letter, TRUNCATED * cut))
            self.free.append((role, text))
            self.bytes += len(role) + len(text)
            self.waiting = 0
        self.waiting += again

    @property
    def full(self) -> bool:
        return len(self.rows) >= RUN_ROWS or self.bytes >= RUN_BYTES

    def solve(self, start: int, goals: dict[int, Found]) -> Found | None:
        return search(self.rows, self.waiting, start, goals)


def replay(audit: str, free: list[tuple[str, str]], lead: list[int], start: int) -> list[str]:
    """The `role:text` lines that the edits leave."""
    lines, state, at, due = [], start, 0, lead[0] if lead else 0
    for edit in audit:
        if edit == "D" and due:
            due -= 1
            continue
        role, text = ("", "") if edit == "I" else free[at]
        if edit == "K":
            state = TAKES[state][role[:1]]
            lines.append(f"{role}:{text}")
        elif edit != "D":
            state = NEXT[state]
            lines.append(f"{NAMES[state]}:{text}")
        if edit != "I":
            at += 1
            due = lead[at]
    return lines


RUN_COLUMNS = (
    "part int, seq int, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long, "
    "low long, high long, first string, last string, cost long, audit string, repaired_sha256 string, "
    "costs array<long>, audits array<string>, roles array<string>, texts array<string>, leads array<long>"
)


def _run_row(run: Run, whole: bool, part: int, seq: int) -> dict:
    row = {
        "part": part, "seq": seq, "whole": whole, **run.faults, "illegal": run.illegal, "turns": run.turns,
        "low": run.low, "high": run.high, "first": run.first, "last": run.last,
    }
    leads = [lead for lead, _, _ in run.rows] + [run.waiting]
    if whole:
        row["cost"], row["audit"] = run.solve(NOTHING, CLOSING)
        lines = replay(row["audit"], run.free, leads, NOTHING)
        return row | {"repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    ways = [run.solve(start, {end: (0, "")}) for start in range(4) for end in range(4)]
    return row | {
        "costs": [w and w[0] for w in ways], "audits": [w and w[1] for w in ways],
        "roles": [r for r, _ in run.free], "texts": [t for _, t in run.free], "leads": leads,
    }


def _runs(parts) -> Iterator[pa.RecordBatch]:
    """A row per run: solved if the conversation is surely whole, else its table.

    The first and the last conversation of a range may go on in the next one.
    """
    task, seq, key, run, began, schema = TaskContext.get().partitionId(), 0, None, None, True, None
    rows: list[dict] = []

    def flush(whole: bool) -> None:
        nonlocal seq
        rows.append({"conv_id": key, **_run_row(run, whole, task, seq)})
        seq += 1

    def batch():
        out = pa.RecordBatch.from_pylist(rows, schema)
        rows.clear()
        return out

    for part in parts:
        if schema is None:
            schema = _arrow_schema(part.schema.field("conv_id").type)
        columns = [part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "new")]
        for conv, *row in zip(*columns):
            if run is None or conv != key:
                if run is not None:
                    flush(whole=not began)
                    began = False
                key, run = conv, Run()
            elif run.full:
                flush(whole=False)
                run, began = Run(), True
            run.add(*row)
        if rows:
            yield batch()
    if run is not None:
        flush(whole=False)
        yield batch()


_KINDS = {
    "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(),
    "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}


def _arrow_schema(key: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", key)] + [(n, _KINDS[k]) for n, k in (c.split() for c in RUN_COLUMNS.split(", "))])


def _best_way(tables: list[tuple[list, list]]) -> tuple[int, list[tuple[int, str]]]:
    """Least total cost and, for every run, its start state and audit.

    Goes from the last run to the first. Audits of equal cost between two
    states are never prefixes of one another, so a comparison of the pieces
    from the left decides; `later` chains pieces without copying them.
    """
    later = {s: (CLOSING[s][0], (CLOSING[s][1], None)) for s in range(4)}
    ways: list[dict[int, tuple[int, str]]] = []
    for costs, audits in reversed(tables):
        now, way = {}, {}
        for start in range(4):
            best = None
            for end in range(4):
                if costs[4 * start + end] is None:
                    continue
                cost = costs[4 * start + end] + later[end][0]
                chain = (audits[4 * start + end], later[end][1])
                if best is None or cost < best[0] or cost == best[0] and _before(chain, best[1]):
                    best = (cost, chain, end)
            now[start], way[start] = best[:2], (best[2], best[1][0])
        later = now
        ways.append(way)
    out, state = [], NOTHING
    for way in reversed(ways):
        end, audit = way[state]
        out.append((state, audit))
        state = end
    return later[NOTHING][0], [*out, (state, CLOSING[state][1])]


def _before(a, b) -> bool:
    """Whether the pieces of one chain, joined, are less than those of another."""
    x, y = a[0], b[0]
    a, b = a[1], b[1]
    while True:
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]
        while not x and a is not None:
            x, a = a[0], a[1]
        while not y and b is not None:
            y, b = b[0], b[1]
        if not x or not y:
            return not x and bool(y)


WAY = "part int, seq int, start int, run_audit string, closing string, blank long, duplicate long, truncated long, illegal long, gaps long, cost long"


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)


def _choose(parts) -> Iterator[pa.RecordBatch]:
    """For conversations of several runs, in order: the way through each run.

    Holds the costs and audits of one conversation (16 bytes per row), no text.
    """
    kinds = [(n, _KINDS[k]) for n, k in (c.split() for c in WAY.split(", "))]
    for key, held in _grouped(parts, ("conv_id", "part", "seq", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last", "costs", "audits")):
        kind, runs = held
        cost, ways = _best_way([(r["costs"], r["audits"]) for r in runs])
        total = {n: sum(r[n] for r in runs) for n in ("blank", "duplicate", "truncated", "illegal", "turns")}
        for a, b in zip(runs, runs[1:]):
            total["illegal"] += a["last"] + b["first"] not in LEGAL
            total["turns"] -= a["high"] is not None and a["high"] == b["low"]
        lows = [r["low"] for r in runs if r["low"] is not None]
        highs = [r["high"] for r in runs if r["high"] is not None]
        total["gaps"] = _gaps(min(lows, default=None), max(highs, default=None), total.pop("turns"))
        out = []
        for n, (run, (start, audit)) in enumerate(zip(runs, ways)):
            closing = ways[-1][1] if n == len(runs) - 1 else ""
            row = {"conv_id": key, "part": run["part"], "seq": run["seq"], "start": start, "run_audit": audit, "closing": closing}
            out.append(row | total | {"cost": cost})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", kind), *kinds]))


def _grouped(parts, names: tuple[str, ...]):
    """Rows of one conversation at a time, from rows in order of conv_id."""

    def rows():
        for part in parts:
            kind = part.schema.field("conv_id").type
            for row in part.select(list(names)).to_pylist():
                yield kind, row

    for _, group in groupby(rows(), lambda r: (r[1]["conv_id"] is None, r[1]["conv_id"])):
        group = list(group)
        yield group[0][1]["conv_id"], (group[0][0], [r for _, r in group])


def _replayed(parts) -> Iterator[pa.RecordBatch]:
    """The repaired text of each run, with the state it ends in closed if it is the last."""
    for part in parts:
        found = []
        for row in part.to_pylist():
            free = list(zip(row["roles"], row["texts"]))
            lines = replay(row["run_audit"] + row["closing"], free, row["leads"], row["start"])
            found.append("\n".join(lines) if lines else None)
        names = ["conv_id", "part", "seq"]
        yield pa.RecordBatch.from_arrays(
            [*[part.column(n) for n in names], pa.array([r["run_audit"] + r["closing"] for r in part.to_pylist()], pa.string()), pa.array(found, pa.string())],
            [*names, "run_audit", "repaired"],
        )


def _hashed(parts) -> Iterator[pa.RecordBatch]:
    """Audit and digest of conversations whose runs come in order; texts go by one at a time."""
    key, kind, digest, audit, any_line = None, None, None, [], False

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([key], kind), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["conv_id", "audit", "repaired_sha256"]
        )

    for part in parts:
        kind = part.schema.field("conv_id").type
        for n in range(part.num_rows):
            conv, piece, text = (part.column(c)[n].as_py() for c in ("conv_id", "run_audit", "repaired"))
            if digest is None or conv != key:
                if digest is not None:
                    yield row()
                key, digest, audit, any_line = conv, hashlib.sha256(), [], False
            audit.append(piece)
            if text is not None:
                digest.update((("\n" if any_line else "") + text).encode())
                any_line = True
    if digest is not None:
        yield row()


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after a damage that their key decides, as `conv_id, turn, role, text, copies`.

    crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes
    away its sentence ends, 3 doubles it, 4 makes it a user's. A null in the key,
    a null role and a null text are one space; turn itself stays null.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    role, text = blank("role"), blank("text")
    return conversations.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """`conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256` per conversation.

    `rows` has `conv_id, turn, role, text` and may have `copies` (how often the
    row stands there). Rows are taken by turn, nulls first, then role and text,
    so repeated rows stand together. Null roles and texts are one space, a null
    conv_id is a conversation of its own, other columns are not read, and an
    empty table gives no rows. Empty and very long texts are texts like others:
    one is held whole, in the task that has its row.

    Equal rows are counted before they are ordered, and a text seen earlier is
    found by an aggregate over the whole conversation. A conversation that ends
    inside its range of rows is solved there. One cut by a range, or of over
    RUN_ROWS rows, gives tables of least costs between states, run by run;
    those are put together without texts, and only the digest of its repaired
    text, which SHA-256 defines in order, reads its runs one after the other.
    Least costs with the least audit compose, so cuts do not change results.
    """
    spark = rows.sparkSession
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    held = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("long").alias("copies"),
    )
    held = held.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    held = held.withColumn("print", F.unhex(F.sha2("text", 256)))
    seen = held.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("print").alias("p")).agg(
        F.min("turn").alias("first_turn"), F.max(F.col("turn").isNull()).alias("early")
    )
    joined = held.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("print") == F.col("p")))
    new = F.when(F.col("early"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first_turn"))
    order = ["conv_id", "turn", "role", "text"]
    ordered = joined.select(*order, "copies", new.alias("new")).repartitionByRange(*order).sortWithinPartitions(*order)

    folder = work_dir(spark, "repair")
    kind = rows.schema["conv_id"].dataType.simpleString()
    # Written, because ranges are cut by samples and a part is a run's name.
    ordered.mapInArrow(_runs, f"conv_id {kind}, {RUN_COLUMNS}").write.parquet(f"{folder}/runs")
    runs = spark.read.parquet(f"{folder}/runs")
    gaps = F.when(F.col("low").isNull(), F.lit(0)).otherwise(
        F.least(F.col("high").cast("decimal(20)") - F.col("low") + 1 - F.col("turns"), F.lit((1 << 63) - 1).cast("decimal(20)"))
    )
    counts = ["blank", "duplicate", "truncated", "illegal"]
    done = runs.where("whole").select("conv_id", gaps.cast("long").alias("gaps"), *counts, "cost", "audit", "repaired_sha256")

    cut = runs.where("NOT whole").drop("whole", "cost", "audit", "repaired_sha256")
    by_place = ["conv_id", "part", "seq"]
    tables = cut.drop("roles", "texts", "leads").repartition("conv_id").sortWithinPartitions(*by_place)
    tables.mapInArrow(_choose, f"conv_id {kind}, {WAY}").write.parquet(f"{folder}/ways")
    ways = spark.read.parquet(f"{folder}/ways")
    texts = cut.select(*by_place, "roles", "texts", "leads").join(ways.select("part", "seq", "start", "run_audit", "closing"), ["part", "seq"])
    lines = texts.select(*by_place, "roles", "texts", "leads", "start", "run_audit", "closing").mapInArrow(
        _replayed, f"conv_id {kind}, part int, seq int, run_audit string, repaired string"
    )
    digests = lines.repartition("conv_id").sortWithinPartitions(*by_place).mapInArrow(
        _hashed, f"conv_id {kind}, audit string, repaired_sha256 string"
    )
    # Of a conversation's runs the first carries its totals.
    firsts = ways.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in ("gaps", *counts, "cost")])
    digests = digests.withColumnRenamed("conv_id", "c")
    joined = firsts.join(digests, F.col("conv_id").eqNullSafe(F.col("c")))
    return done.unionByName(joined.select(*done.columns))


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """`repair` of the damaged rows, with a row for every original conv_id.

    Conversations that lost all rows have zeros, an empty audit and the digest
    of the empty string.
    """
    fixed = repair(damage(conversations))
    every = conversations.select(F.col("conv_id").alias("c")).distinct()
    joined = every.join(fixed, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        F.col("c").alias("conv_id"),
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
