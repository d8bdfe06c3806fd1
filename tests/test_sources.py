import json

from pyspark.sql import functions as F

from quillstone.operators import answering
from quillstone.sources import announcements, files
from quillstone.streaming import ingest


def fetch(code, page, size):
    """Two pages of announcements."""
    rows = [{"announcementTitle": f"<em>{code}</em> {page}", "announcementTime": 0, "adjunctUrl": "u", "adjunctSize": None}]
    return {"announcements": rows if page < 3 else [], "hasMore": page < 2}


def test_announcement_pages(spark, tmp_path):
    module = tmp_path / "own_fetcher.py"
    module.write_text("from test_sources import fetch\n")
    spark.dataSource.register(announcements.AnnouncementSource)
    reader = announcements.AnnouncementReader({"codes": "1,2", "fetcher": "test_sources:fetch"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[0] for r in rows] == ["1", "1", "2", "2"] and rows[0][4] == 0


def test_chunk_lines_and_manifest(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "b"}\n\n{"chunk_id": "a", "page_start": 3}\n')
    assert [r.chunk_id for r in files.read_chunks(spark, str(tmp_path / "c.jsonl"), 1).collect()] == ["a"]
    (tmp_path / "m.json").write_text(json.dumps({"report_period": "2026H1", "reports": [{"code": "000001", "pages": None}, {"code": "600000", "pages": 7}]}, indent=1))
    got = files.read_manifest(spark, str(tmp_path / "m.json")).orderBy("code").collect()
    assert [(r.code, r.pages, r.report_period) for r in got] == [("000001", None, "2026H1"), ("600000", 7, "2026H1")]


def test_reports_and_partitions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x" * 20_000)
    (tmp_path / "in" / "b.pdf").write_bytes(b"x")
    reports = files.read_reports(spark, str(tmp_path / "in"))
    assert reports.count() == 1 and files.page_counts(reports).first().pages is None
    out = str(tmp_path / "chunks")
    files.write_by_code(spark.createDataFrame([("1", "a"), ("2", "b")], "code string, text string"), out)
    files.write_by_code(spark.createDataFrame([("2", "c")], "code string, text string"), out)
    got = files.read_by_code(spark, out).select(F.col("code").cast("string").alias("code"), "text")
    assert sorted(map(tuple, got.collect())) == [("1", "a"), ("2", "c")]


def test_generator_failure_keeps_the_row(spark):
    def broken(prompt):
        raise RuntimeError("no model")

    df = spark.createDataFrame([(1, "p")], "qid int, prompt string")
    r = answering.generate(df, broken).first()
    assert r.qid == 1 and r.answer is None and "no model" in r.generation_error


def test_stream_takes_a_document_once(spark, tmp_path):
    base, schema = str(tmp_path), "doc_id long, text string"
    run = lambda: ingest.stream_chunks(spark, f"{base}/in", spark.createDataFrame([], schema).schema, f"{base}/out", f"{base}/state", 10, 3)
    spark.createDataFrame([(1, "a line"), (1, "a"), (2, "other")], schema).coalesce(1).write.parquet(f"{base}/in")
    run()
    spark.createDataFrame([(1, "a later text\nof two lines"), (3, "new"), (None, "x")], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    run()
    got = sorted((r.doc, r.chunk, r.batch) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [(1, 1, 0), (2, 1, 0), (3, 1, 1)]
