"""Readers of uploads, stores and logs."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from quillwork.operators.components import connected
from quillwork.sources import files

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(path, paragraphs: list[str]) -> None:
    body = "".join(f"<w:p>{p}</w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')


def test_uploads(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain é\nline")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    docx(tmp_path / "c.docx", ["<w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r>", "<w:r><w:t>three</w:t></w:r>"])
    (tmp_path / "d.docx").write_bytes(b"no archive")
    (tmp_path / "e.png").write_bytes(b"\x89PNG")
    rows = {r.path.rsplit("/", 1)[1]: (r.text, r.unsupported) for r in files.read_uploads(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": ("plain é\nline", False), "b.csv": ("x,y\n1,2\n", False), "c.docx": ("One two\nthree", False), "d.docx": (None, True), "e.png": (None, True)}


def test_valid_texts(spark):
    rows = [("ok",), ("  ",), ("",), (None,), ("x" * (files.MOST_CHARS + 1),)]
    found = spark.createDataFrame(rows, "s string").select(files.is_valid_text(F.col("s")).alias("v")).collect()
    assert [bool(r.v) for r in found] == [True, False, False, False, False]


def test_training_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text('text,label,reason,source\n"a, ""b""\nc",retain,r,s\nd,remove,,\n')
    rows = [tuple(r) for r in files.read_training_rows(spark, str(tmp_path / "t.csv")).collect()]
    assert rows == [('a, "b"\nc', "retain", "r", "s"), ("d", "remove", None, None)]


def test_json_store_is_newest_first(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"id": 1, "at": "2024-01-01"}, {"id": 2, "at": "2024-03-01"}, {"id": 3}], indent=1))
    assert [r.id for r in files.read_json_store(spark, str(tmp_path / "s.json"), "id long, at string", "at").collect()] == [2, 1, 3]


def test_log_events(spark, tmp_path):
    (tmp_path / "l.log").write_text('10:00 info {"event": "run_start", "n": 1}\nno json here\n10:01 {"event": "other", "n": 2}\n10:02 {broken\n10:03 x {"event": "run_end", "n": 3}\n')
    rows = files.read_log_events(spark, str(tmp_path / "l.log"), "event string, n long", "^run_").orderBy("n").collect()
    assert [(r.event, r.n) for r in rows] == [("run_start", 1), ("run_end", 3)]


def test_recordset(spark):
    df = spark.createDataFrame([('[{"a": 1, "b": "x"}, {"a": 2}]',), ("[]",), (None,), ("broken",)], "j string")
    assert sorted((r.a is None, r.a, r.b) for r in files.recordset(df, "j", "a int, b string").collect() if r.a) == [(False, 1, "x"), (False, 2, None)]


def test_components_of_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 201)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []
