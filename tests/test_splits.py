"""Byte ranges of any size read what a whole file holds."""

import csv
import io
import json
import random

import pytest

from embedlake.functions import text as tx
from embedlake.sources import splits


def cuts(data, size):
    return [(b, min(b + size, len(data))) for b in range(0, max(len(data), 1), size)]


def entered(data, size, kind, tmp_path):
    """Profiles and entry states of a file's ranges, without Spark."""
    path = tmp_path / f"f.{kind}"
    path.write_bytes(data)
    rows, state, depth = [], 0, 0
    with open(path, "rb") as file:
        for begin, stop in cuts(data, size):
            row = splits._profile(file, begin, stop, len(data), kind) | {"begin": begin, "stop": stop, "state": state, "depth": depth}
            rows.append(row)
            depth += row["deltas"][state] if "deltas" in row else 0
            state = row["states"][state] if "states" in row else 0
    return str(path), rows


SIZES = [1, 2, 3, 5, 17, 1000]


@pytest.mark.parametrize("size", SIZES)
def test_charset_and_gates(size, tmp_path):
    samples = ["aß𝔘c".encode(), b"", b"\x80abc", "ß".encode()[:1], b"ab\xff", "𝔘".encode()[:3] + b"a", b"a\xf0\x90", "é" .encode("latin-1") + b"xxxx"]
    samples += ["ééééé€€𝔘𝔘".encode(), b"\xed\xa0\x80", b"\xe2\x82\x82\x82", b"x" * 20 + b"\xc3"]
    for data in samples:
        _, rows = entered(data, size, "xml", tmp_path)
        try:
            data.decode()
            valid = True
        except UnicodeDecodeError:
            valid = False
        assert all(r["utf8"] for r in rows) == valid, data
    for text in ["xx=CmD", "a=su m", "x=importXML y", "a@b", "=\x00sum", "plain = text"]:
        _, rows = entered(text.encode(), size, "csv", tmp_path)
        assert any(r["marked"] for r in rows) == any(p in text.lower() for p in tx.FORMULA_PATTERNS), text
        assert any(r["nul"] for r in rows) == ("\x00" in text)


def read_csv(data, size, tmp_path):
    path, rows = entered(data, size, "csv", tmp_path)
    out = []
    for r in rows:
        out += splits._csv_range(path, len(data), r["begin"], r["stop"], r["state"], rows[0]["delimiter"], "UTF-8")
    return [(dict(c), m) for _, c, m in out]


@pytest.mark.parametrize("size", SIZES)
def test_csv_records(size, tmp_path):
    draw = random.Random(size)
    cells = ["a", "", 'say ""x""', "x,y", "line\nbreak", "cr\r\nlf", '"', "5\" pipe", "é", " z ", "\n\n"]
    table = [["na\nme", "b", "B", ""]] + [[draw.choice(cells) for _ in range(4)] for _ in range(60)]
    held = io.StringIO()
    for row in table:
        ends = draw.choice(["\n", "\r\n"])
        quoted = ['"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') or draw.random() < 0.2 else c for c in row]
        held.write(",".join(quoted) + ends + draw.choice(["", "\n"]))
    data = b"\xef\xbb\xbf" + held.getvalue().encode()
    got = read_csv(data, size, tmp_path)
    names = ["na\nme", "b1", "B2", "_c3"]
    expected = [r for r in table[1:] if any(r)]
    assert [[c[n] or "" for n in names] for c, _ in got if any(c.values())] == expected
    assert not any(m for _, m in got)


@pytest.mark.parametrize("size", SIZES)
def test_odd_csv(size, tmp_path):
    assert read_csv(b'\n \na,b\n\n1,2\n5" x,y\n"q"z,w\nshort\nlong,er,still\n"open\nend', size, tmp_path) == [
        ({"a": "1", "b": "2"}, False), ({"a": '5" x', "b": "y"}, False), ({"a": "qz", "b": "w"}, False),
        ({"a": "short", "b": None}, False), ({"a": "long", "b": "er"}, True), ({"a": "open\nend", "b": None}, False),
    ]
    assert read_csv(b"", size, tmp_path) == [] and read_csv(b"a;b\n", size, tmp_path) == []
    assert read_csv(b"a;b\rx;\"\"\r", size, tmp_path) == [({"a": "x", "b": ""}, False)]


def read_array(data, size, tmp_path):
    path, rows = entered(data, size, "json", tmp_path)
    level, opens, closes = 1, rows[0].get("opens"), None
    if rows[0]["shape"] == "envelope":
        found = [b for r in rows for b in splits._data_keys([FakeBatch([{"path": path, **{k: r[k] for k in ("begin", "stop", "state", "depth")}}])])]
        found = [b.to_pylist()[0] for b in found]
        level, opens = 2, min((o for f in found for o in f["opens"]), default=None)
        if opens is None:
            return None
        closes = min((c for f in found for c in f["closes"] if c > opens), default=None)
    out = []
    for r in rows:
        out += splits._item_range(path, len(data), r["begin"], r["stop"], r["state"], r["depth"], level, opens, closes, "UTF-8")
    return [v for _, v in out]


class FakeBatch:
    def __init__(self, rows):
        self.rows = rows

    def to_pylist(self):
        return self.rows


@pytest.mark.parametrize("size", [1, 3, 7, 64, 10_000])
@pytest.mark.parametrize("step", [4, 1 << 20])
def test_json_items(size, step, tmp_path, monkeypatch):
    monkeypatch.setattr(splits, "STEP", step)
    monkeypatch.setattr(splits, "HEAD_BYTES", 50)
    draw = random.Random(size)
    texts = ["", "a", 'quote " here', "back\\", '\\\\"', "[x, {y}]", "é\n", "\\" * 9]
    items = [{draw.choice(texts): draw.choice(texts), "n": [1, {"k": draw.choice(texts)}]} for _ in range(25)]
    for held in ([], items, [1, "a,b", None, {}]):
        assert list(map(json.loads, read_array(json.dumps(held, indent=draw.choice([None, 1])).encode(), size, tmp_path))) == held
        envelope = {"a,b": {"data": [1]}, "x": [[5], 6], "data": held, "after": [{"z": 1}], 'da"ta': [2]}
        text = " \n" + json.dumps(envelope, ensure_ascii=False)
        assert list(map(json.loads, read_array(text.encode(), size, tmp_path))) == held
    assert read_array(b'{"x": [1]} ' + b" " * 50, size, tmp_path) is None and read_array(b'{"x": [1', size, tmp_path) is None
    broken = read_array(b'[{"a": 1}, {"a"', size, tmp_path)
    assert broken[0] == '{"a": 1}' and broken[-1] == ""
    assert read_array(b"[1,]", size, tmp_path) == ["1"] and read_array(b"[,1]", size, tmp_path) == ["", "1"]


def test_csv_scan_agrees_with_a_reader_byte_by_byte():
    draw = random.Random(9)
    for _ in range(3000):
        data = "".join(draw.choice('",\nab\r') for _ in range(draw.randint(0, 12))).encode()
        for first in range(5):
            state, ends = first, []
            for i, c in enumerate(data.decode()):
                if state == splits.QUOTED:
                    state = splits.QUOTE if c == '"' else splits.QUOTED
                elif c == '"' and state in (splits.RECORD, splits.CELL, splits.QUOTE):
                    state = splits.QUOTED
                elif c in "\r\n":
                    state = splits.RECORD
                    ends.append(i + 1)
                else:
                    state = splits.CELL if c == "," else splits.BARE
            got, places = splits.CsvScan(",").run(data, first)
            same = {splits.RECORD: splits.RECORD}
            assert same.get(got, got) == state and places.tolist() == ends, (data, first)
            if data:
                assert splits.CsvScan(",").states(data)[first] == state
