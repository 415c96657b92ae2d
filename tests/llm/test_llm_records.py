"""Filter audit, web archives and conversation repair against brute force and on odd rows."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations, product

import pytest

from embedlake.llm import conversation_repair as cr
from embedlake.llm import filter_audit, warc
from test_llm_ops import ODD, corpus, empty, frame, odd

# ---- 11 ------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_masks(rows, labels):
    out = []
    for key, text, part in rows:
        text = text or ""
        words = plain_words(text)
        mask = (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words))
        mask += 4 * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + 8 * bool(re.search(r"[#$%&*|]", text))
        mask += 16 * any(k is not None and key is not None and k < key and (t or "") == text for k, t, _ in rows)
        good = key is not None and any(k == key and q == 1 for k, q, _ in labels)
        toxic = key is not None and any(k == key and x == 1 for k, _, x in labels)
        out.append((part or "", mask, good, toxic))
    return out


def brute_audit(rows, labels):
    masks, out = brute_masks(rows, labels), {}
    for part in {m[0] for m in masks}:
        held = [m[1:] for m in masks if m[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = held
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [m for m in left if m[0] & bit]
                left = [m for m in left if not m[0] & bit]
                shapley[letter] += len(gone)
                fails = sum(bool(m[0] & bit) for m in held)
                out[part, "".join(order), step] = [
                    len(left), len(gone), fails - len(gone), sum(m[0] == bit for m in held), sum(m[1] for m in gone), sum(m[2] for m in gone)
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, mask int, digest string")
    held = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in held}


def test_filter_audit(spark):
    draw = random.Random(8)
    texts = [t for _, t in corpus(40)] + [" ".join(draw.choices("ab cd Ef gh".split(), k=300)), "x\x1cy\x85z \x0b# " * 250, None, "", " \n"]
    texts += [" ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250))]
    rows = [(draw.choice([None, *range(30)]), draw.choice(texts), draw.choice(["s", "s", "s", "t", "", None])) for _ in range(150)]
    rows += [(k, t, "odd") for k, t in ODD]
    labels = [(draw.choice([None, *range(30)]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(40)]
    expected = brute_audit(rows, labels)
    assert len(expected) == 4 * 600
    assert audited(spark, rows, labels) == expected


def test_filter_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(docs, labels).count() == 0


def test_matrix_is_over_one_dictionary(spark, monkeypatch):
    rows = corpus(50) + ODD
    docs = frame(spark, rows).repartition(3)
    shards, words = filter_audit.document_terms(docs, ["doc_id"])
    held, names = shards.collect(), {r["term_id"]: r["word"] for r in words.collect()}
    every = Counter(w for _, t in rows for w in plain_words(t))
    assert sorted(names) == list(range(len(every))) and set(names.values()) == set(every)
    found = Counter()
    for shard in held:
        for i, doc in enumerate(shard["docs"]):
            ids = shard["indices"][shard["indptr"][i] : shard["indptr"][i + 1]]
            counts = shard["data"][shard["indptr"][i] : shard["indptr"][i + 1]]
            assert ids == sorted(set(ids))
            found[doc["doc_id"], doc["digest"], frozenset(zip((names[x] for x in ids), counts))] += 1
    expected = Counter(
        (k, bytearray(hashlib.sha256((t or "").encode()).digest()).hex(), frozenset(Counter(plain_words(t)).items())) for k, t in rows
    )
    assert Counter({(k, bytes(d).hex(), c): n for (k, d, c), n in ((((a, bytes(b), c), n)) for (a, b, c), n in _hashable(found).items())}) == expected


def _hashable(found):
    return Counter({(k, bytes(d), c): n for (k, d, c), n in found.items()})


def test_long_texts_are_counted_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(filter_audit, "PIECE_BYTES", 50)
    monkeypatch.setattr(filter_audit, "CHUNK", 7)
    text = "a b  ß c\n" * 40 + "x" * 200 + " a é" + " "
    shard = filter_audit._Shard()
    shard.add([{"k": 1}], pa.array([text]))
    names = list(shard.codes)
    assert {names[c]: n for c, n in zip(shard.indices[0], shard.data[0])} == Counter(plain_words(text))
    assert filter_audit._facts("AÉß#x|".encode()) == (hashlib.sha256("AÉß#x|".encode()).digest(), 6, 1, 2)


# ---- 12 ------------------------------------------------------------------

LONG, SAME = "é" * 60, "<p>same</p>" * 20


def brute_revisits(rows):
    """(page_id, bytes, digest, type, refers_to), as a bag."""
    out, first = [], {}
    for key, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        again = len(raw) >= 100 and raw in first
        out.append((key, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
        first.setdefault(raw, key)
    return Counter(out)


def page_rows():
    draw = random.Random(3)
    own = [f"<html>{i}\r\n\r\nWARC/1.1\r\n" + "x" * draw.randint(0, 300) for i in range(20)]
    rows = [(i, f"http://h{i}.org/a%20b", draw.choice([*own, SAME, SAME, LONG, "a" * 99, "a" * 100, "", None])) for i in range(90)]
    rows += [(None, None, SAME), (None, "http://x\r\nWARC-Type: revisit", SAME), (5, "", LONG), (5, "u", LONG), (None, None, None)]
    return rows + [(200, "u", "y" * 200), (200, "u", "y" * 200), (None, "u", "only null ids " * 20), (None, "u", "only null ids " * 20)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "n", 1) for r in rows], "page_id long, url string, html string, path string, ordinal int")


def test_revisits(spark, tmp_path):
    rows = page_rows()
    index = warc.archived_pages(pages(spark, rows).repartition(4), str(tmp_path)).collect()
    number = lambda x: None if x is None else int(x)
    got = Counter((number(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_page"])) for r in index)
    assert got == brute_revisits(rows)
    assert Counter(r["url"] for r in index) == Counter(r[1] for r in rows)
    assert warc.archived_pages(pages(spark, []), str(tmp_path / "none")).count() == 0


def test_archives_are_standard(spark, tmp_path):
    warc.archived_pages(pages(spark, page_rows()).coalesce(2), str(tmp_path)).count()
    files = list((tmp_path / "deduplicated").glob("*.warc.gz"))
    assert files
    kinds = Counter()
    for file in files:
        data = gzip.open(file).read()
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            block, data = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
            assert lines[0] == "WARC/1.1" and data[:4] == b"\r\n\r\n"
            assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
            kinds[fields["WARC-Type"]] += 1
            if fields["WARC-Type"] == "revisit":
                assert fields["WARC-Profile"] == warc.SAME_PAYLOAD and block.endswith(b"\r\n\r\n")
            data = data[4:]
    assert kinds["revisit"] > 10 and kinds["warcinfo"] == len(files)


def test_old_revisits_find_their_original(spark, tmp_path):
    """Deduplicating deduplicated archives changes nothing; a revisit without its original stays."""
    rows = page_rows()
    first = warc.archived_pages(pages(spark, rows), str(tmp_path / "a"))
    again = warc.deduplicate(first.select("path"), str(tmp_path / "b"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_page"]
    assert Counter(warc.referred(warc.scan(again)).select(columns).collect()) == Counter(first.select(columns).collect())
    lone = str(tmp_path / "lone.warc")
    out = warc.Writer(lone, "2024-01-01T00:00:00Z")
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 500\r\n\r\n"
    out.add(warc._record("revisit", "1", "2024-01-01T00:00:00Z", block, {"Content-Type": warc.HTTP, "WARC-Payload-Digest": "sha1:ABC"}))
    out.close()
    kept = warc.scan(warc.deduplicate(spark.createDataFrame([(lone,)], "path string"), str(tmp_path / "c"))).collect()
    assert [(r["record_type"], r["payload_digest"], r["payload_bytes"], r["refers_to"]) for r in kept] == [("revisit", "sha1:ABC", 500, None)]


def test_damaged_archives_are_noticed(spark, tmp_path):
    path = str(tmp_path / "x.warc.gz")
    out = warc.Writer(path, "2024-01-01T00:00:00Z")
    row = {"record_id": "1", "date": "d", "url": None, "page_id": None, "payload_digest": "00"}
    out.add(warc._response(row, warc._http(3) + b"abc"))
    out.close()
    with pytest.raises(ValueError, match="damaged"):
        list(warc._rows(path))
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-20])
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records(path))


# ---- 13 ------------------------------------------------------------------

STATES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def brute_repair(rows):
    """Least (cost, audit) by dynamic programming over rows and the last role put out."""
    now, seen, lines = {"": (0, "", ())}, set(), []

    def inserted(states):
        # One insertion leads to each state of a turn; two at most ever pay.
        for _ in range(3):
            for state, (cost, audit, out) in list(states.items()):
                to = "a" if state == "u" else "u"
                found = (cost + 3, audit + "I", (*out, {"u": "user:", "a": "assistant:"}[to]))
                if to not in states or found[:2] < states[to][:2]:
                    states[to] = found
        return states

    faults = []
    for role, text in rows:
        words = plain_words(text)
        fault = None if words and (role, text) not in seen else "duplicate" if words else "blank"
        if fault is None and words[-1][-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        faults.append(fault)
        before, now = inserted(dict(now)), {}
        for state, (cost, audit, out) in before.items():
            moves = [(state, 4, "D", ())]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if role[:1] in STATES[state]:
                    moves.append((role[:1], extra, "K", (f"{role}:{text}",)))
                for name in ("user", "assistant"):
                    if name[0] in STATES[state]:
                        moves.append((name[0], 3 + extra, "R", (f"{name}:{text}",)))
            for to, more, edit, line in moves:
                found = (cost + more, audit + edit, out + line)
                if to not in now or found[:2] < now[to][:2]:
                    now[to] = found
    ends = [v for k, v in inserted(now).items() if k in ("", "a")]
    cost, audit, out = min(ends)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    return {
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
    }


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute_conversations(rows, damaged):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in damaged if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        out[conv] = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **brute_repair([r[1:] for r in own])}
    return out


def conversation_rows(n=60, most=14, seed=6):
    draw = random.Random(seed)
    texts = ["Hi.", "Yes!", "no", "So? ", "", " \t", "Fine.\x1c", "Ünder .", "a.b", None]
    roles = ["user", "assistant", "user", "assistant", "user", "assistant", "system", "tool", "", None, "sys"]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(draw.randint(1, most)):
            role = ("user", "assistant")[turn % 2] if draw.random() < 0.6 else draw.choice(roles)
            text = draw.choice(texts) if draw.random() < 0.4 else f"Text {draw.randint(0, 40)}."
            rows.append((conv, draw.choice([turn, turn, turn, turn + 3, None, -turn]), role, text))
    return rows


def repaired(frame):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in frame.collect()}


@pytest.mark.parametrize("run_rows, ranges", [(400, 3), (2, 9)])
def test_conversation_repair(spark, monkeypatch, run_rows, ranges):
    monkeypatch.setattr(cr, "RUN_ROWS", run_rows)
    rows = conversation_rows()
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = spark.createDataFrame([(*r, 7, "c") for r in rows], "conv_id long, turn long, role string, text string, part int, c string")
        assert repaired(cr.repaired_conversations(held)) == brute_conversations(rows, brute_damage(rows))
        plain = [(c, t, r or " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
        assert repaired(cr.repair(held)) == brute_conversations(plain, plain)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_conversation_repair_of_one_conversation_in_many_tasks(spark):
    rows = [(1, t, r, x) for _, t, r, x in conversation_rows(200, 12)] + [(1, 99, "user", "Same.")] * 50
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    held = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert repaired(cr.repair(held)) == brute_conversations(plain, plain)


def test_conversation_repair_of_nothing(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert cr.repaired_conversations(spark.createDataFrame([], schema)).count() == 0
    lost = next(str(i) for i in range(99) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = cr.repaired_conversations(spark.createDataFrame([(lost, 0, "user", "x")], schema)).collect()[0]
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_search_is_the_best_of_all_edits():
    """Against every string of edits up to a length, on all short sequences of roles."""
    for n in range(3):
        for letters in product("suax", repeat=n):
            for cuts in ([0] * n, [3 * (i % 2) for i in range(n)]):
                best = min(_every_edit(letters, cuts))
                assert cr.search([(0, x, c) for x, c in zip(letters, cuts)], 0, cr.NOTHING, cr.CLOSING) == best, (letters, cuts)


def _every_edit(letters, cuts):
    for edits in (e for size in range(len(letters), len(letters) + 3) for e in product("DIKR", repeat=size)):
        if len(edits) - edits.count("I") != len(letters):
            continue
        at, cost, fixed = 0, 0, []
        for e in edits:
            if e == "I":
                cost += 3
                fixed.append("ua")
                continue
            x, extra = letters[at], cuts[at]
            at += 1
            cost += {"D": 4, "K": extra, "R": 3 + extra}[e]
            if e != "D":
                fixed.append(x if e == "K" else "ua")
        if any(re.fullmatch("(s?(ua)+)?", "".join(roles)) for roles in product(*fixed)):
            yield cost, "".join(edits)


def test_search_stays_fast_on_a_full_run():
    import time

    for seed in range(4):
        draw = random.Random(seed)
        rows = [(0, draw.choice(["suax", "uuua", "ua", "aaau"][seed]), 3 * (draw.random() < 0.4)) for _ in range(cr.RUN_ROWS)]
        began = time.time()
        assert all(cr.search(rows, 0, s, {e: (0, "")}) for s in range(4) for e in (2, 3))
        assert time.time() - began < 20
