import datetime as dt

from pyspark.sql import functions as F

from lodegraph.operators import bm25
from lodegraph.sources import files
from lodegraph.streaming import upsert


def test_scan_directory(spark, tmp_path):
    for name, data in {"src/a.rs": b"fn a() {}", "src/.hid/b.rs": b"x", "src/c.bin": b"x", "src/d.rs": b"\xff\xfe", "node_modules/e.js": b"x", "big.rs": b"x" * 1_000_001, "f.pdf": b"%PDF"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = files.scan_directory(spark, str(tmp_path), ignores=("node_modules",))
    assert [(r["path"].rsplit("/", 1)[1], r["language"], r["content"]) for r in got.collect()] == [("a.rs", "rs", "fn a() {}")]
    with_pdf = files.scan_directory(spark, str(tmp_path), ignores=("node_modules",), pdf_text=lambda b: b.decode())
    assert {r["language"] for r in with_pdf.collect()} == {"rs", "pdf"}


def test_index_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "id long, text string")
    t = bm25.tokenized(d, "id", "text")
    files.save_index({"postings": bm25.postings(t, "id"), "doc_len": bm25.doc_lengths(t, "id")}, str(tmp_path))
    back = files.load_index(spark, str(tmp_path))
    assert sorted(back) == ["doc_len", "postings"] and back["postings"].count() == 3


def test_graph_sinks(spark, tmp_path):
    n = spark.createDataFrame([(1, "a</script>", "function", "f", 1, 2), (2, "b", "class", "f", 3, 4)], "id int, name string, kind string, file_path string, line_start int, line_end int")
    e = spark.createDataFrame([(1, 2, "calls")], "src int, dst int, kind string")
    files.graph_json(n, e, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/links")).select("source", "target").collect()[0] == (1, 2)
    page = files.graph_page(n, e)
    assert '"src": 1' in page and "a</script>" not in page


def ts(h):
    return dt.datetime(2026, 1, 1, h)


FEED = [(1, "/a\\b.rs", "CREATE", "v1", ts(1), ts(1)), (1, "/a\\b.rs", "CREATE", "v1", ts(1), ts(1)), (2, "/a/b.rs", "Modified", "v2", ts(3), ts(3)), (3, "/a/b.rs", "modify", "late", ts(2), ts(9)), (4, "/c", "create", "c", ts(1), ts(1)), (5, "/c", "remove", None, None, ts(5)), (6, "/d", "???", "d", ts(1), ts(1)), (7, None, "create", "e", ts(1), ts(1))]


def test_latest_and_live(spark):
    f = spark.createDataFrame(FEED, upsert.FEED)
    assert sorted((r["path"], r["op"], r["seq"]) for r in upsert.latest(f).collect()) == [("/a/b.rs", "modify", 2), ("/c", "delete", 5)]
    assert [(r["path"], r["content"]) for r in upsert.live_content(f).collect()] == [("/a/b.rs", "v2")]
    assert upsert.change_counts(f).agg(F.sum("n")).collect()[0][0] == 7


def test_stream_equals_batch(spark, tmp_path):
    f = spark.createDataFrame(FEED, upsert.FEED)
    src = str(tmp_path / "in")
    seen = []
    f.where("seq <= 2").coalesce(1).write.parquet(src)
    upsert.upsert_stream(spark, src, str(tmp_path / "t"), str(tmp_path / "c"), lambda d, n: seen.append(n)).awaitTermination()
    f.where("seq > 2").coalesce(1).write.mode("append").parquet(src)
    upsert.upsert_stream(spark, src, str(tmp_path / "t"), str(tmp_path / "c"), lambda d, n: seen.append(n)).awaitTermination()
    last = upsert.stored_changes(spark, str(tmp_path / "t"))
    upsert.compact(spark, str(tmp_path / "t"), str(tmp_path / "t2"))
    assert sorted(map(tuple, upsert.stored_changes(spark, str(tmp_path / "t2")).drop("v").collect())) == sorted(map(tuple, last.drop("v").collect()))
    assert sorted(map(tuple, last.select("path", "op", "seq").collect())) == sorted(map(tuple, upsert.latest(f).select("path", "op", "seq").collect()))


def test_index_stream(spark, tmp_path):
    one = "def alpha():\n    return beta(1)\n\n\ndef beta(x):\n    return x + 1\n"
    rows = [(1, "/r/a.py", "create", one, ts(1), ts(1)), (2, "/r/b.py", "create", one.replace("alpha", "gamma"), ts(1), ts(1)), (3, "/r/a.py", "modify", one.replace("alpha", "delta"), ts(3), ts(3)), (4, "/r/b.py", "delete", None, ts(4), ts(4)), (5, "/r/a.py", "modify", "late = 1 + 2 + 3\n", ts(2), ts(9))]
    f = spark.createDataFrame(rows, upsert.FEED)
    for lo, hi in ((1, 2), (3, 4), (5, 5)):
        f.where(f"seq between {lo} and {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        upsert.index_stream(spark, str(tmp_path / "in"), str(tmp_path / "x"), str(tmp_path / "c")).awaitTermination()
    chunks = upsert.current(spark, str(tmp_path / "x"), "chunks").collect()
    assert {r["path"] for r in chunks} == {"/r/a.py"} and any("delta" in r["content"] for r in chunks) and not any("late" in r["content"] or "alpha" in r["content"] for r in chunks)
    assert {r["name"] for r in upsert.current(spark, str(tmp_path / "x"), "nodes").collect()} == {"a", "delta", "beta"}
    ids = {r["id"] for r in chunks}
    assert {r["id"] for r in upsert.current(spark, str(tmp_path / "x"), "embeddings").collect()} == ids
    assert upsert.current(spark, str(tmp_path / "x"), "edges").where("kind = 'calls'").count() == 1


def test_disk_statistics(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "i/chunks"))
    rows = {r["table"]: r for r in files.disk_statistics(spark, str(tmp_path / "i")).collect()}
    assert rows["total"]["bytes"] >= rows["chunks"]["bytes"] > 0 and rows["chunks"]["size"].endswith(("KB", " B"))
