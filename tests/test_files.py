"""File formats, archives and folder ingestion on generated fixtures."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from embedlake.operators.archives import archive_limits
from embedlake.sources import archives, jsonl, splits
from embedlake.sources.files import FileRejected, ingest, inspect, list_files, require_single, scan_subsets
from embedlake.streaming.ingest import watch_folder

ROWS = [
    ("Wie geht das?", "So geht das.", "Gar nicht."),
    ("Größe wählen?", 'Bitte "Maß" nehmen', "Nein, danke"),
    ("Wo?", "Hier\nund dort", "Nirgends"),
]


def quoted(value, sep):
    if any(c in value for c in [sep, '"', "\n"]):
        return '"' + value.replace('"', '""') + '"'
    return value


def csv_text(header, rows, sep=","):
    lines = [sep.join(header)] + [sep.join(quoted(v, sep) for v in r) for r in rows]
    return "\n".join(lines) + "\n"


def records(header, rows):
    return [dict(zip(header, r)) for r in rows]


def xlsx(path, header, rows):
    strings = sorted({v for r in [header, *rows] for v in r})
    sheet = []
    for i, row in enumerate([header, *rows], 1):
        cells = "".join(
            f'<c r="{chr(65 + j)}{i}" t="s"><v>{strings.index(v)}</v></c>' for j, v in enumerate(row)
        )
        sheet.append(f'<row r="{i}">{cells}</row>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    escape = lambda v: v.replace("&", "&amp;").replace("<", "&lt;")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(
            "xl/workbook.xml",
            f'<workbook {main} xmlns:r="{rel}"><sheets>'
            '<sheet name="A" sheetId="1" r:id="rId7"/></sheets></workbook>',
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            f'<Relationship Id="rId7" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        z.writestr(
            "xl/sharedStrings.xml",
            f"<sst {main}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>",
        )
        z.writestr(
            "xl/worksheets/sheet1.xml",
            f"<worksheet {main}><sheetData>{''.join(sheet)}</sheetData></worksheet>",
        )


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    std = ["prompt", "chosen", "rejected"]
    text = {
        "comma.csv": csv_text(std, ROWS),
        "semicolon.csv": csv_text(["Query", "ANSWER", "random"], ROWS, ";"),
        "tab.csv": csv_text(["id", "q", "answer"], [("1", "a", "b"), ("2", "c", "d")], "\t"),
        "%00nullbyte.csv": csv_text(std, ROWS),
        "; rm -rf %2F.csv": csv_text(std, ROWS),
        "array.json": json.dumps(records(std, ROWS), ensure_ascii=False),
        "late.json": json.dumps([{"question": "a"}, {"question": "b", "answer": "c"}]),
        "envelope.json": json.dumps({"data": records(std, ROWS)}, ensure_ascii=False),
        "lines.jsonl": "".join(json.dumps(r) + "\n" for r in records(["question", "positive", "negative"], ROWS)),
        "doc.xml": "<?xml version='1.0' encoding='UTF-8'?>\n<data>"
        + "".join(
            "<record>" + "".join(f"<{k}>{v}</{k}>" for k, v in zip(std, r)) + "</record>"
            for r in [*ROWS, ("leer", "", "x")]
        )
        + "</data>",
        "formula.csv": csv_text(std, [("=SUM(1+1)", " +x", "ok"), ("-1", "@me", "a=b")]),
        "wrong.csv": csv_text(["prompt", "other"], [("a", "b")]),
        "wrong.jsonl": '{"prompt": "a"}\n',
        "broken.jsonl": '{"question": "a", "positive": "b"}\n{"question": \n',
        "header_only.csv": "prompt,chosen\n",
        "empty.csv": "",
        "notes.txt": "id,anchor,chosen\n1,a,b\n",
        "nul.csv": "prompt,chosen\na,b\x00\n",
    }
    for name, content in text.items():
        (root / name).write_bytes(content.encode())
    (root / "latin.csv").write_bytes(csv_text(std, [("Größe", "Maß", "Öl")]).encode("latin-1"))
    (root / "bom.csv").write_bytes(b"\xef\xbb\xbf" + csv_text(std, ROWS).encode())
    xlsx(root / "book.xlsx", std, ROWS)
    (root / "bad.xlsx").write_bytes(b"not a workbook")
    return root


@pytest.fixture(scope="module")
def ingested(spark, folder):
    return ingest(spark, list_files(spark, str(folder)))


def by_name(frame, column="path"):
    out = {}
    for row in frame.collect():
        out.setdefault(row[column].rsplit("/", 1)[-1], []).append(row)
    return out


def test_every_file_has_a_verdict(ingested, folder):
    verdicts = {n: r[0] for n, r in by_name(ingested.files).items()}
    assert set(verdicts) == {p.name for p in folder.iterdir()}
    errors = {n: (r.error, r.detail) for n, r in verdicts.items() if r.error}
    assert errors == {
        "wrong.csv": ("missing_column", "positive"),
        "wrong.jsonl": ("missing_column", "positive"),
        "broken.jsonl": ("invalid_format", None),
        "bad.xlsx": ("invalid_format", None),
        "header_only.csv": ("empty_file", None),
        "empty.csv": ("empty_file", None),
        "notes.txt": ("unsupported_format", None),
        "nul.csv": ("nul_byte", None),
    }
    assert ingested.rejects.count() == len(errors)


def test_rows_of_every_format(ingested):
    rows = {
        n: sorted((r.question, r.positive, r.negative) for r in found)
        for n, found in by_name(ingested.rows).items()
    }
    same = ["comma.csv", "semicolon.csv", "%00nullbyte.csv", "; rm -rf %2F.csv", "array.json"]
    same += ["envelope.json", "lines.jsonl", "bom.csv", "book.xlsx"]
    for name in same:
        assert rows[name] == sorted(ROWS), name
    assert rows["doc.xml"] == sorted([*ROWS, ("leer", "", "x")])
    assert rows["latin.csv"] == [("Größe", "Maß", "Öl")]
    assert rows["tab.csv"] == [("a", "b", None), ("c", "d", None)]
    assert len(rows["late.json"]) == 2
    assert ("b", "c", None) in rows["late.json"] and ("a", None, None) in rows["late.json"]


def test_formulas_are_escaped(ingested):
    rows = by_name(ingested.rows)["formula.csv"]
    assert {(r.question, r.positive, r.negative) for r in rows} == {
        ("'=SUM(1+1)", "' +x", "ok"),
        ("'-1", "'@me", "a=b"),
    }


def test_classification_counts_and_names(ingested):
    found = {n: r[0] for n, r in by_name(ingested.files).items()}
    assert found["tab.csv"].classification == "D"
    assert found["comma.csv"].classification == "T"
    assert found["comma.csv"].rows == 3
    assert found["; rm -rf %2F.csv"].file_name == "__rm_-rf__2F.csv"
    assert found["semicolon.csv"].delimiter == ";"
    assert found["latin.csv"].encoding == "ISO-8859-1"


@pytest.mark.parametrize("size", [13, 60])
def test_ranges_of_any_size_read_the_same(spark, folder, ingested, size):
    names = ["comma.csv", "tab.csv", "latin.csv", "bom.csv", "; rm -rf %2F.csv", "array.json", "late.json", "envelope.json"]
    names += ["lines.jsonl", "broken.jsonl", "wrong.csv", "header_only.csv", "nul.csv"]
    small = ingest(spark, list_files(spark, *[str(folder / n) for n in names]), range_bytes=size)
    verdict = lambda r: (r.path.rsplit("/", 1)[-1], r.error, r.detail, r.encoding, r.delimiter, r.rows, r.classification)
    assert {verdict(r) for r in small.files.collect()} == {verdict(r) for r in ingested.files.collect() if verdict(r)[0] in names}
    row = lambda r: (r.path, r.question or "", r.positive or "", r.negative or "")
    kept = {r.path for r in small.rows.collect()}
    assert sorted(map(row, small.rows.collect())) == sorted(row(r) for r in ingested.rows.collect() if r.path in kept)


def test_one_reader_per_format(spark, tmp_path):
    """The plan does not grow with the shapes of the files."""
    for i in range(12):
        (tmp_path / f"f{i}.csv").write_text(f"question,positive,spare{i}\na{i},b,c\n")
        (tmp_path / f"g{i}.xml").write_text(f"<r><row{i}><question>x{i}</question><positive>y</positive></row{i}></r>")
    result = ingest(spark, list_files(spark, str(tmp_path)))
    assert {r.question for r in result.rows.collect()} == {f"{c}{i}" for c in "ax" for i in range(12)}
    plan = result.rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_files_keep_to_their_own_columns(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<d><r><prompt>p</prompt><chosen>c</chosen></r><r><prompt/><chosen>e</chosen></r></d>")
    (tmp_path / "b.xml").write_text("<d><r><prompt>p</prompt><chosen>c</chosen><rejected>n</rejected></r></d>")
    (tmp_path / "broken.xml").write_text("<d><r><prompt>p</prompt>")
    (tmp_path / "none.xml").write_text("<d></d>")
    (tmp_path / "wide.csv").write_text('"ques\ntion",question,positive\n1,2,3\n')
    (tmp_path / "other.csv").write_text('"ques\nother",answer,prompt\n4,5,6\n')
    (tmp_path / "open.json").write_text('[{"question": "a", "positive": "b"}')
    (tmp_path / "keyless.json").write_text('{"x": [{"question": "a"}]' + " " * (1 << 20) + "}")
    result = ingest(spark, list_files(spark, str(tmp_path)))
    files = {n: (r[0].error, r[0].classification) for n, r in by_name(result.files).items()}
    assert files == {
        "a.xml": (None, "D"), "b.xml": (None, "T"), "broken.xml": ("invalid_format", None), "none.xml": ("empty_file", None),
        "wide.csv": (None, "D"), "other.csv": (None, "D"), "open.json": ("invalid_format", None), "keyless.json": ("invalid_format", None),
    }
    rows = {n: sorted((r.question, r.positive, r.negative) for r in found) for n, found in by_name(result.rows).items()}
    assert rows["a.xml"] == [("", "e", None), ("p", "c", None)]
    assert rows["wide.csv"] == [("2", "3", None)] and rows["other.csv"] == [("6", "5", None)]


def test_strict_patterns_are_found_anywhere(spark, tmp_path):
    filler = b"question,positive\n" + b"a,b\n" * 600_000
    (tmp_path / "late.csv").write_bytes(filler + b"=SuM(1),c\n")
    (tmp_path / "clean.csv").write_bytes(filler)
    result = ingest(spark, list_files(spark, str(tmp_path)), strict=True, range_bytes=1 << 20)
    assert {n: r[0].error for n, r in by_name(result.files).items()} == {"late.csv": "malicious_content", "clean.csv": None}


def test_ids_follow_the_content(spark, tmp_path):
    (tmp_path / "a.csv").write_text("question,positive\na,b\n")
    read = lambda: ingest(spark, list_files(spark, str(tmp_path))).files.first().dataset_id
    first = read()
    assert read() == first
    (tmp_path / "a.csv").write_text("question,positive\na,c\n")
    assert read() != first


def test_strict_mode(spark, folder):
    names = ["formula.csv", "comma.csv", "tab.csv"]
    files = list_files(spark, *[str(folder / n) for n in names])
    result = ingest(spark, files, strict=True)
    errors = {n: r[0].error for n, r in by_name(result.files).items()}
    assert errors == {
        "formula.csv": "malicious_content",
        "comma.csv": "invalid_format",
        "tab.csv": None,
    }


def test_explicit_mapping(spark, folder):
    files = list_files(spark, str(folder / "tab.csv"), str(folder / "comma.csv"))
    result = ingest(spark, files, mapping={"question": "ID", "positive": "q", "negative": None})
    found = {n: r[0] for n, r in by_name(result.files).items()}
    assert found["comma.csv"].error == "missing_column"
    assert found["comma.csv"].detail == "ID"
    assert {(r.question, r.positive) for r in result.rows.collect()} == {("1", "a"), ("2", "c")}


def test_single_failure_raises(spark, folder):
    one = ingest(spark, list_files(spark, str(folder / "wrong.csv")))
    with pytest.raises(FileRejected, match="missing_column: positive"):
        require_single(one)
    two = ingest(spark, list_files(spark, str(folder / "wrong.csv"), str(folder / "tab.csv")))
    assert require_single(two) is two


def test_object_json_is_flattened(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"question": "a", "meta": {"answer": "b"}}))
    files = list_files(spark, str(tmp_path))
    result = ingest(spark, files, mapping={"positive": "meta.answer"})
    assert [(r.question, r.positive) for r in result.rows.collect()] == [("a", "b")]


def test_size_cap(spark, folder):
    seen = inspect(list_files(spark, str(folder / "comma.csv")), max_bytes=10)
    assert seen.first().error == "file_too_large"


def test_archive_expansion(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(40):
            z.writestr(f"d{i % 3}/f{i}.csv", csv_text(["prompt", "chosen"], [("a", str(i))]))
        z.writestr("d0/../../escape.csv", csv_text(["prompt", "chosen"], [("a", "out")]))
        z.writestr("__MACOSX/x.csv", "hidden")
        z.writestr(".hidden", "hidden")
        z.writestr("d0/blank.csv", "  \n ")
        z.writestr("d0/none.csv", "")
    with zipfile.ZipFile(tmp_path / "bomb.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("zeros.csv", "0" * 5_000_000)
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    files = list_files(spark, str(tmp_path))
    members, verdicts = archives.expand(spark, files)
    assert {r.archive.rsplit("/", 1)[-1]: r.verdict for r in verdicts.collect()} == {
        "good.zip": "ok",
        "bomb.zip": "suspicious_ratio",
        "broken.zip": "unreadable",
    }
    errors = {r.member: r.error for r in members.collect()}
    assert len(errors) == 43 and {m for m, e in errors.items() if e} == {"d0/blank.csv"}
    result = ingest(spark, members.filter("error is null").select("path", "length"))
    assert {r.positive for r in result.rows.collect()} == {*map(str, range(40)), "out"}
    assert [r.reason for r in result.rejects.collect()] == ["empty_file"]


def test_archive_member_limit(spark):
    members = spark.range(12).selectExpr(
        "'a.zip' archive", "concat('f', id) member", "10L file_size", "5L compress_size"
    )
    assert archive_limits(members, max_members=10).first().verdict == "too_many_files"
    assert archive_limits(members, max_bytes=100).first().verdict == "too_large"


def test_canonical_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("a b", "c ", None), ('q"', "é", "x")], jsonl.TRIPLET_SCHEMA
    )
    out = str(tmp_path / "out")
    assert jsonl.write_canonical(df, out) == 2
    lines = [r.value for r in spark.read.text(out).collect()]
    assert all(" " not in line and " " not in line for line in lines)
    assert any('"negative":null' in line for line in lines)
    assert sorted(jsonl.read_triplets(spark, out).collect()) == sorted(df.collect())
    assert jsonl.delete_stored(out) and not jsonl.delete_stored(out)


def test_plain_json_sink(spark, tmp_path):
    df = spark.createDataFrame([("é", None)], "a string, b string")
    jsonl.write_json(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":"é","b":null}'


def test_subset_and_split_scan(spark, tmp_path):
    for subset in ["default", "de"]:
        for split in ["train", "test"]:
            part = tmp_path / f"subset={subset}" / f"split={split}"
            part.mkdir(parents=True)
            lines = [{"instruction": "i", "output": split, "n": 1}, {"instruction": "lacks the output"}]
            (part / "x.json").write_text("".join(json.dumps(x) + "\n" for x in lines))
    df = scan_subsets(spark, str(tmp_path), "org/set")
    got = {(r.dataset_name, r.file_name, r.positive, r.classification) for r in df.collect()}
    assert got == {
        ("org/set_train", "org_set_train.jsonl", "train", "D"),
        ("org/set_test", "org_set_test.jsonl", "test", "D"),
        ("org/set_train_de", "org_set_train_de.jsonl", "train", "D"),
        ("org/set_test_de", "org_set_test_de.jsonl", "test", "D"),
    }


def test_folder_stream(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    inbox.mkdir()
    for i in range(3):
        (inbox / f"f{i}.csv").write_text(csv_text(["prompt", "chosen"], [("a", str(i))]))
    (inbox / "bad.csv").write_text("x,y\n1,2\n")
    (inbox / "empty.csv").write_text("")
    run = lambda: watch_folder(spark, str(inbox), str(out), str(mark), max_files=2).awaitTermination()
    run()
    (inbox / "later.jsonl").write_text('{"q": "a", "answer": "later"}\n')
    (inbox / "none.json").write_text("")
    run()
    lines = spark.read.text(f"{out}/datasets")
    stored = lines.select(F.from_json("value", "positive string").alias("r")).select("r.*")
    assert {r.positive for r in stored.collect()} == {"0", "1", "2", "later"}
    registry = spark.read.parquet(f"{out}/registry")
    assert registry.count() == 4 and {r.rows for r in registry.collect()} == {1}
    refused = {(r.source_file.rsplit("/", 1)[-1], r.reason) for r in spark.read.parquet(f"{out}/rejects").collect()}
    assert refused == {("bad.csv", "missing_column"), ("empty.csv", "empty_file"), ("none.json", "empty_file")}
    assert spark.read.parquet(f"{out}/rejects").count() == 3


def test_wide_rows_charsets_and_lost_files(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("question,positive\na,b\nc,d,EXTRA\n")
    (tmp_path / "short.csv").write_text('question,positive,negative\n"a,1",b\n')
    (tmp_path / "latin.jsonl").write_bytes('{"question": "Grüße", "positive": "ä"}\n'.encode("latin-1"))
    (tmp_path / "latin.json").write_bytes('[{"question": "Größe", "positive": "ä"}]'.encode("latin-1"))
    late = b"question,positive\n" + b"a,b\n" * 300_000
    (tmp_path / "late.csv").write_bytes(late + "é,ü\n".encode("latin-1"))
    (tmp_path / "nul.csv").write_bytes(late + b"\x00,b\n")
    files = list_files(spark, str(tmp_path))
    lost = spark.createDataFrame([(f"file:{tmp_path}/gone.csv", 5)], files.schema)
    result = ingest(spark, files.unionByName(lost))
    errors = {n: r[0].error for n, r in by_name(result.files).items()}
    assert errors == {
        "wide.csv": "invalid_format", "short.csv": None, "latin.jsonl": None, "latin.json": None,
        "late.csv": None, "nul.csv": "nul_byte", "gone.csv": "unreadable",
    }
    rows = by_name(result.rows)
    assert rows["latin.jsonl"][0].question == "Grüße" and rows["latin.json"][0].question == "Größe"
    short = rows["short.csv"][0]
    assert (short.question, short.positive, short.negative) == ("a,1", "b", None)
    assert ("é", "ü") in {(r.question, r.positive) for r in rows["late.csv"]}


def test_subsets_go_by_their_own_columns(spark, tmp_path):
    parts = [("a", ["prompt", "chosen", "rejected"]), ("b", ["query", "chosen", "rejected"]), ("c", ["input", "output"])]
    for subset, keys in parts:
        part = tmp_path / f"subset={subset}" / "split=train"
        part.mkdir(parents=True)
        (part / "x.json").write_text(json.dumps({k: f"{subset} {k}" for k in keys}) + "\n\n")
    found = scan_subsets(spark, str(tmp_path), "t").collect()
    assert {(r.question, r.positive, r.negative, r.classification) for r in found} == {
        ("a prompt", "a chosen", "a rejected", "T"),
        ("b query", "b chosen", "b rejected", "T"),
        ("c input", "c output", None, "D"),
    }


@pytest.mark.parametrize("few", [10_000, 0])
def test_cells_are_never_broadcast(spark, tmp_path, monkeypatch, few):
    """A file is one row before it is read, its records are many."""
    monkeypatch.setattr("embedlake.sources.files.FEW_FILES", few, raising=False)
    written = [(f"q{i}", "p" * 500, f"n{i}") for i in range(2_000)]
    (tmp_path / "a.csv").write_text(csv_text(["question", "positive", "negative"], written))
    rows = ingest(spark, list_files(spark, str(tmp_path))).rows
    found = sorted((r.question, r.positive, r.negative) for r in rows.collect())
    assert found == sorted(written)
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    if few:
        assert "BuildRight" in plan and "BuildLeft" not in plan
    else:
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_tasks_follow_bytes(spark, tmp_path):
    """Small ranges share tasks, so the driver does not keep one task for each; large ones are read alone."""
    cores = spark.sparkContext.defaultParallelism
    file = spark.createDataFrame([("f", 1 << 20)], "path string, length long")
    small = splits.spread(splits.byte_ranges(file, 1 << 10))
    assert small.count() == 1 << 10
    assert small.rdd.getNumPartitions() <= 2 * cores
    large = file.withColumn("length", F.lit(64 * cores * splits.RANGE_BYTES))
    assert splits.spread(splits.byte_ranges(large)).rdd.getNumPartitions() == 64 * cores
    written = [(f"q{i}", "p, \n\"quoted\" " * (i % 7), f"n{i}") for i in range(3_000)]
    (tmp_path / "a.csv").write_text(csv_text(["question", "positive", "negative"], written))
    (tmp_path / "b.jsonl").write_text("".join(json.dumps({"question": q, "positive": p, "negative": n}) + "\n" for q, p, n in written))
    read = ingest(spark, list_files(spark, str(tmp_path)), range_bytes=1 << 9).rows
    found = sorted((r.question, r.positive or "", r.negative) for r in read.collect())
    assert found == sorted(written + written)
