import datetime
import io
import json
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from orebed.schema import STANDARD_ROW
from orebed.sources import files
from orebed.streaming import events as streams


@pytest.mark.parametrize("bad", ["/etc/x", "a/../../b", "s3://b/x", "..", "a\\..\\b"])
def test_paths_stay_inside(bad):
    with pytest.raises(ValueError):
        files.safe_path("/root", bad)
    assert files.safe_path("/r/", "a/b") == "/r/a/b"


def test_standard_tables(spark, tmp_path):
    rows = spark.createDataFrame([("Кабель", "12,x", 3.5, "{}")], "name string, qty string, amount double, raw_row string")
    files.write_standard(rows, f"{tmp_path}/d1/_parquet/t.parquet")
    got = files.standard_tables(spark, str(tmp_path), ["d1", "missing", "d1"]).collect()
    assert len(got) == 1 and got[0].qty is None and got[0].amount == 3.5 and got[0].dataset_id == "d1" and got[0].section == ""
    assert len(STANDARD_ROW) == 34 and STANDARD_ROW.names[:3] == ["doc_type", "doc_title", "source_file"] and STANDARD_ROW.names[9:13] == ["unit", "qty", "qty_per_unit", "price"] and STANDARD_ROW.names[-4:] == ["source_page", "table_index", "needs_ocr", "extractor"]


def test_csv_of_any_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Имя;Кол-во\nКабель;1,5\n".encode("cp1251"))
    (tmp_path / "b.csv").write_bytes("﻿name,qty\nx,2\n,\n".encode())
    got = sorted((r.path[-5:], r.row, r.cells) for r in files.csv_rows(spark, str(tmp_path)).collect())
    assert got == [("a.csv", 0, {"Имя": "Кабель", "Кол-во": "1,5"}), ("b.csv", 0, {"name": "x", "qty": "2"}), ("b.csv", 1, {"name": "", "qty": ""})]


def test_docx_tables(spark, tmp_path):
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "t.docx").write_bytes(data.getvalue())
    assert [(r.table, r.row, r.cells) for r in files.docx_rows(spark, str(tmp_path)).collect()] == [(0, 0, ["A", ""])]


def test_mail(spark, tmp_path):
    (tmp_path / "m.eml").write_bytes(b"From: A <a@x.example>\r\nTo: B@y.example\r\nSubject: Re: Plan\r\nMessage-ID: <ID@X>\r\nDate: Mon, 01 Jan 2024 10:00:00 +0300\r\n\r\nHello\r\n")
    r = files.mail_messages(spark, str(tmp_path)).head()
    assert (r.message_id, r.subject, r.recipients, r.sent.isoformat(), r.text.strip()) == ("id@x", "Re: Plan", ["b@y.example"], "2024-01-01T07:00:00", "Hello")


def test_model_graph(spark, tmp_path):
    g = {"id": "m", "elements": [{"id": "1", "name": "Wall", "properties": {"h": "3"}}, {"id": "2"}], "relations": [{"source_id": "1", "target_id": "2", "relation_type": "contains"}] * 2}
    (tmp_path / "g.json").write_text(json.dumps(g))
    e, r, p = files.model_graph(spark, str(tmp_path))
    assert (e.count(), r.count(), [tuple(x) for x in p.collect()]) == (2, 1, [("m", "1", "h", "3")])


def test_file_map_and_changes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.TXT").write_text("abc")
    r = files.file_map(spark, str(tmp_path)).head()
    assert (r["size"], r.extension, r.parent) == (3, "txt", "d")
    t = "2024-01-01 00:00:00"
    snap = lambda rows: spark.createDataFrame(rows, "path string, size long, mtime string").withColumn("mtime", F.col("mtime").cast("timestamp"))
    got = files.changes(snap([("a", 1, t), ("b", 1, t), ("c", 1, t)]), snap([("a", 1, t), ("b", 2, t), ("d", 1, t)]))
    assert {r.path: r.status for r in got.collect()} == {"a": "unchanged", "b": "updated", "c": "removed", "d": "added"}


def test_clean_matrix():
    rows = [["Name", "Qty", "", "Qty"], ["", "plan", "", "plan"], ["", "", "", ""], ["Cable", "1", "", "2"], ["Tray", "3", "", "4,5"]]
    assert files.clean_matrix(rows) == (["Name", "Qty plan", "Qty plan_2"], [["Cable", "1", "2"], ["Tray", "3", "4,5"]])
    assert files.clean_matrix([["", ""]]) == ([], [])


def run(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"SELECT * FROM {name}")


def landed(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    (tmp_path / "in").mkdir()
    for i in range(len(batches)):
        for f in sorted((tmp_path / f"in{i}").glob("*.parquet")):
            shutil.copy2(f, tmp_path / "in" / f"{i:03}.parquet")
    return streams.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)


def test_windows_leave_late_rows_out(spark, tmp_path):
    schema = "ts timestamp, k string, v double"
    at = lambda m: datetime.datetime(2024, 1, 1, m // 60, m % 60)
    s = landed(spark, tmp_path, [[(at(1), "a", 1.0), (at(3), "a", 2.0)], [(at(130), "a", 5.0)], [(at(131), "a", 1.0)], [(at(2), "a", 99.0), (at(300), "a", 7.0)]], schema)
    got = run(spark, streams.windowed(s, "ts", "k", "v", "10 minutes", "30 minutes"), "late", "append").collect()
    assert {(r.start.hour * 60 + r.start.minute, r.n, r.total) for r in got} == {(0, 2, 3.0), (130, 2, 6.0)}


def test_stream_sessions_equal_the_batch(spark, tmp_path, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "user_id")
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = streams.event_stream(spark, f"{tmp_path}/in", e.schema)
    got = run(spark, streams.sessions(s, "ts", "user_id", "6 hours", "1 day"), "sessions", "append").groupBy().agg(F.count("*"), F.sum("n")).head()
    every = e.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    closed = every.where(F.col("session_window.end") <= e.agg(F.max("ts") - F.expr("interval 1 day")).head()[0])
    assert tuple(got) == tuple(closed.agg(F.count("*"), F.sum("n")).head()) and got[0] > 0


def test_cursor_starts_anew_with_the_validity(spark, tmp_path):
    s = landed(spark, tmp_path, [[("in", 1, 5), ("in", 1, 6)], [("in", 1, 6), ("in", 1, 7)], [("in", 2, 1)]], "folder string, validity long, uid long")
    got = run(spark, streams.cursors(s, "folder", "validity", "uid"), "cursors", "update").collect()
    assert [(r.validity, r.last_uid, r.accepted) for r in got] == [(1, 6, 2), (1, 7, 1), (2, 1, 1)]


def test_upsert_is_idempotent(spark, tmp_path):
    write = streams.upsert(f"{tmp_path}/t", ["k"], "o")
    batch = lambda rows: spark.createDataFrame(rows, "k string, v string, o long")
    write(batch([("a", "1", 1), ("b", "1", 1)]), 0)
    for _ in range(2):
        write(batch([("a", "2", 2)]), 1)
    assert {(r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/t/v1").collect()} == {("a", "2"), ("b", "1")}


def test_progress(spark):
    log = spark.createDataFrame([("d", "PENDING", 1), ("d", "CONVERT", 1), ("e", "ERROR", 2)], "k string, s string, t long")
    assert {r.k: (r.state, r.steps) for r in streams.progress_of(log, "k", "s", "t").collect()} == {"d": ("CONVERT", 2), "e": ("ERROR", 1)}
