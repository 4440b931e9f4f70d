import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.sources import files, store
from lodestone.streaming import state


def docx(paragraphs, table=()):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    if table:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in table) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_text_with_fallback(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo\r\nline\n".encode())
    (tmp_path / "b.LOG").write_bytes("caf\xe9".encode("latin-1"))
    got = {r.filename: r for r in files.read_text(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text_content == "héllo\nline" and got["b.LOG"].text_content == "café" and got["b.LOG"].file_type == "log" and got["a.txt"].total_pages == 1


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(["One", " ", "Two words"], [("a", "b"), ("c", "d")]))
    r = files.read_docx(spark, str(tmp_path)).head()
    assert r.sections == ["One", "Two words", "a | b\nc | d"] and r.total_pages == 1 and r.text_content == "One\n\nTwo words\n\na | b\nc | d"


def test_images(spark, tmp_path):
    w = h = 2
    head = b"BM" + (54 + 16).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "a.bmp").write_bytes(head + bytes(16))
    assert [(r.height, r.width, r.channels) for r in files.read_images(spark, str(tmp_path)).collect()] == [(2, 2, 3)]


def test_paged_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"l{i}\n" for i in range(5)))
    spark.dataSource.register(files.PagedText)
    got = spark.read.format("paged_text").option("path", str(tmp_path)).option("lines", 2).load().orderBy("page").collect()
    assert [(r.page, r.text) for r in got] == [(1, "l0\nl1\n"), (2, "l2\nl3\n"), (3, "l4\n")]


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    merged = store.upsert(old, spark.createDataFrame([("b", 5), ("c", 6)], "id string, v int"), "id")
    assert {tuple(r) for r in merged.collect()} == {("a", 1), ("b", 5), ("c", 6)}
    assert store.export_bundle({"t": merged}, str(tmp_path / "b")).head().n_rows == 3
    assert spark.read.parquet(store.write_version(merged, str(tmp_path / "t"), 1)).count() == 3
    assert store.read_feedback(spark, str(tmp_path / "no"), str(tmp_path / "none")).count() == 0


def test_image_chunk_fallback(spark):
    s = spark.createDataFrame([(1, "x [Image URL: /a.png]", False, ""), (2, "y", False, "")], "n int, text string, has_image boolean, image_url string")
    assert [r.n for r in store.image_chunks(s, "n").collect()] == [1]


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_memory_and_weights(spark, tmp_path):
    for k in range(2):
        rows = [(1, t, "user", f"m{t}") for t in range(8 * k, 8 * k + 8)]
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(state.conversation_memory(stream, 12), "memory_turns", "update")
    got = spark.table("memory_turns").where("turn = 15").select("position").collect()
    assert got[-1].position == 12

    spark.createDataFrame([("thumbs_up", ["a", "b"]), ("thumbs_down", ["a"])], "rating string, citations array<string>").write.parquet(str(tmp_path / "fb"))
    run(state.feedback_weights(spark.readStream.schema("rating string, citations array<string>").parquet(str(tmp_path / "fb"))), "weights", "complete")
    assert {r.source_file: r.boost for r in spark.table("weights").collect()} == {"a": -0.03, "b": 0.12}


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello world")
    stream = spark.readStream.format("text").option("wholetext", True).load(str(tmp_path / "in"))
    q = state.ingest(stream, str(tmp_path / "out"), lambda d: d.select(F.upper("value").alias("text")), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).head().text == "HELLO WORLD"


def test_pages_by_range(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.txt").write_text("".join(f"line {k}\n" for k in range(120)))
    (tmp_path / "p" / "empty.txt").write_text("")
    count, page = lambda c: len(files.lines_reader(c)), lambda c, n: files.lines_reader(c)[n - 1]
    pages = files.read_pages(spark, str(tmp_path / "p"), count, page, per_task=1)
    got = {(r.file_path.rsplit("/", 1)[1], r.page): r.text for r in pages.collect()}
    assert set(got) == {("a.txt", 1), ("a.txt", 2), ("a.txt", 3)} and got["a.txt", 3].startswith("line 110\n")
    text = {r.file_path.rsplit("/", 1)[1]: r.text_content for r in files.page_text(pages).collect()}
    assert set(text) == {"a.txt"} and text["a.txt"].startswith("[Page 1]\nline 0\n") and "\n\n[Page 2]\nline 55" in text["a.txt"]
    assert [r.page for r in files.read_pages(spark, str(tmp_path / "p" / "a.txt"), count, page, start=2, end=2).collect()] == [2]

    def broken(*_):
        raise ValueError("no library")

    kept = files.read_pages(spark, str(tmp_path / "p" / "a.txt"), broken, broken, fallback=(count, page))
    assert sorted(r.page for r in kept.collect()) == [1, 2, 3]


def test_docx_images(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "My file.docx", "w") as z:
        for n in (10, 2):
            z.writestr(f"word/media/image{n}.png", bytes([n]))
    rows = files.read_docx_images(spark, str(tmp_path / "*.docx")).orderBy("image_no").collect()
    assert [(r.image_no, bytes(r.image)) for r in rows] == [(1, b"\x02"), (2, b"\x0a")]
    assert rows[0].text == "[IMAGE / FIGURE: Embedded Document Graphic 1]\n[Image URL: /images/My_file_img1.png]"


def test_feedback_sink(spark, tmp_path):
    e = spark.createDataFrame([("q", "a", "thumbs_up", "m", ["x"], 1.0), ("r", "a\nb", "thumbs_down", "m", [], 2.0)], "query string, answer string, rating string, model string, citations array<string>, timestamp double")
    for _ in range(2):
        store.write_feedback(e.coalesce(1), str(tmp_path / "s"), str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "s")).count() == spark.read.json(str(tmp_path / "g")).count() == 4
    got = store.read_feedback(spark, str(tmp_path / "none"), str(tmp_path / "g"))
    assert got.count() == 4 and {r.answer for r in got.collect()} == {"a", "a\nb"}


def test_page_ranges_push_filters_down(spark, tmp_path):
    from lodestone.sources import paged

    (tmp_path / "k=1").mkdir()
    bodies = {"k=1/a.txt": "".join(f"zeile ü {k}\n" for k in range(230)), "b.txt": "no line feed", "c.txt": "", "_hidden.txt": "x"}
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    pages = paged.read(spark, str(tmp_path), paged.TextPages(10), per_task=4)
    got = {(r.file_path.removeprefix(f"{tmp_path}/"), r.page): r.text for r in pages.collect()}
    want = {(name, k // 10 + 1): "".join(body.splitlines(keepends=True)[k : k + 10]) for name, body in bodies.items() if name[0] != "_" for k in range(0, max(1, body.count("\n")), 10)}
    assert got == want and pages.rdd.getNumPartitions() == 6 + 1 + 1
    some = pages.where("page between 9 and 14")
    assert some.rdd.getNumPartitions() == 2 and sorted(r.page for r in some.collect()) == list(range(9, 15))
    one = pages.where(F.col("file_path") == f"{tmp_path}/b.txt").where("page in (1, 7) and text <> 'x'")
    assert one.rdd.getNumPartitions() == 1 and [r.text for r in one.collect()] == ["no line feed"]
    assert "Exchange" not in pages._jdf.queryExecution().toString()


def test_text_pages_at_block_ends(monkeypatch):
    import io

    from lodestone.sources import paged

    monkeypatch.setattr(paged, "BLOCK", 3)
    body = b"a\nbb\n\nccc\nd"
    reader = paged.TextPages(2)
    starts = reader.index(io.BytesIO(body))
    assert starts == [0, 5, 10, 11]
    assert [reader.page(io.BytesIO(body), k + 1, s) for k, s in enumerate(zip(starts, starts[1:]))] == ["a\nbb\n", "\nccc\n", "d"]
    assert paged.TextPages(1).index(io.BytesIO(b"")) == [0, 0] and paged.TextPages(1).index(io.BytesIO(b"a\n")) == [0, 2]


MERGED = "chunk_id string, v int, meta map<string, string>"


def test_merge_store(spark, tmp_path):
    from lodestone.sources.merge import MergeStore

    s = MergeStore(spark, str(tmp_path / "m"), MERGED, buckets=8)
    assert s.read().count() == 0 and s.merge(spark.createDataFrame([], MERGED), "none") and not s.merge(spark.createDataFrame([], MERGED), "none")
    first = [(f"c{k}", k, {"a": str(k)}) for k in range(100)]
    assert s.merge(spark.createDataFrame(first, MERGED), "one")
    before = s.live()
    change = [("c5", 50, {"b": "x"}), ("c5", 50, {"b": "y"}), ("c5", 50, None), ("new", 1, None)]
    for parts in (1, 3):  # the same rows however they are dealt: a replay and a fresh store agree
        other = MergeStore(spark, str(tmp_path / f"m{parts}"), MERGED, buckets=8)
        other.merge(spark.createDataFrame(change, MERGED).repartition(parts), "x")
        assert {(r.chunk_id, r.v, str(r.meta)) for r in other.read().collect()} == {("c5", 50, "{'b': 'y'}"), ("new", 1, "None")}
    assert s.merge(spark.createDataFrame(change, MERGED), "two") and not s.merge(spark.createDataFrame(first, MERGED), "one")
    rows = {r.chunk_id: (r.v, r.meta) for r in s.read().collect()}
    assert len(rows) == 101 and rows["c5"] == (50, {"b": "y"}) and rows["c6"] == (6, {"a": "6"})
    moved = {b for b, w in s.live().items() if before.get(b) != w}
    assert 1 <= len(moved) <= 2
    only = s.read(sorted(moved))  # what a merge of those keys reads: files of the touched buckets
    opened = {r[0] for r in only.select(F.input_file_name()).distinct().collect()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in opened} <= moved and only.count() < 101
    assert "PartitionFilters: [" in only._jdf.queryExecution().toString()
    assert [r.v for r in s.find(["c7"]).collect()] == [7]
    assert s.merge(spark.createDataFrame([("c1", 9, None)], MERGED), "three", deleted=spark.createDataFrame([("c1",), ("c2",)], "chunk_id string"))
    rows = {r.chunk_id: r.v for r in s.read().collect()}
    assert rows["c1"] == 9 and "c2" not in rows and len(rows) == 100
    # a merge that died before its commit leaves rows that no reader sees
    spark.createDataFrame([("ghost", 1, None, 0)], f"{MERGED}, bucket int").write.partitionBy("bucket").parquet(str(tmp_path / "m" / "data" / "writing=wdead"))
    assert s.read().count() == 100 and s.vacuum() >= 1 and s.read().count() == 100
    assert not os.path.exists(tmp_path / "m" / "data" / "writing=wdead")
    with pytest.raises(Exception, match="chunk_id is null"):
        s.merge(spark.createDataFrame([(None, 1, None)], MERGED), "bad")


def test_ingest_merges_each_batch_once(spark, tmp_path):
    from lodestone.sources.merge import MergeStore, ingest

    s, src = MergeStore(spark, str(tmp_path / "m"), "chunk_id string, text string", buckets=4), tmp_path / "in"
    src.mkdir()
    parse = lambda df: df.select(F.substring("value", 1, 1).alias("chunk_id"), F.col("value").alias("text"))
    for k, body in enumerate(("a1\nb1\n", "b2\nc2\n")):
        (src / f"{k}.txt").write_text(body)
        q = ingest(spark.readStream.text(str(src)), s, parse, str(tmp_path / "cp"))
        q.awaitTermination()
    assert {(r.chunk_id, r.text) for r in s.read().collect()} == {("a", "a1"), ("b", "b2"), ("c", "c2")}
    assert not s.merge(spark.createDataFrame([("a", "again")], "chunk_id string, text string"), "ingest-1")


def test_rows_that_differ_in_a_map_keep_one_row(spark):
    new = spark.createDataFrame([("k", {"a": v}) for v in "xzy"], "id string, meta map<string, string>")
    for parts in (1, 2, 3, 5):
        assert store.upsert(new.limit(0), new.repartition(parts), "id").head().meta == {"a": "z"}
    deep = new.select("id", F.struct("meta").alias("s"))
    with pytest.raises(ValueError, match="can't be ordered by s"):
        store.upsert(deep.limit(0), deep, "id")


def test_sessions_expire_in_a_stream(spark, tmp_path):
    """Sessions by timers, batch by batch: what is alive at the end is what the batch filter calls active."""
    from lodestone.operators import chat

    src, hour, start = tmp_path / "in", 3600, 1_700_000_000
    src.mkdir()
    batches = [
        [("a", "create", 0), ("b", "create", hour), ("c", "create", hour), ("c", "delete", hour + 60)],
        [("a", "create", 2 * hour), ("tick", "other", 3 * hour + 10)],  # a is alive, so nothing is made; then its time passes
        [("b", "delete", 5 * hour), ("a", "create", 6 * hour)],  # b had expired before its delete
        [("tick", "other", 7 * hour)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "session_id string, event string, t long").select("session_id", "event", F.timestamp_seconds(F.col("t") + start).alias("at")).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        part = next((tmp_path / f"b{k}").glob("part-*.parquet"))
        os.rename(part, src / f"{k}.parquet")
        os.utime(src / f"{k}.parquet", (k + 1, k + 1))
    events = spark.readStream.schema("session_id string, event string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = state.session_life(events).writeStream.format("memory").queryName("lives").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.session_id, r.status, r.at_ms // 1000 - start) for r in spark.table("lives").collect()}
    assert got == {("a", "active", 0), ("b", "active", hour), ("c", "active", hour), ("c", "deleted", hour + 60), ("a", "expired", 3 * hour), ("b", "expired", 4 * hour), ("a", "active", 6 * hour)}
    gone = {(r.session_id, r.expires_ms) for r in spark.table("lives").where("status <> 'active'").collect()}
    alive = {r.session_id for r in spark.table("lives").where("status = 'active'").collect() if (r.session_id, r.expires_ms) not in gone}
    made = spark.createDataFrame([("a", 3 * hour), ("b", 4 * hour), ("a", 9 * hour)], "session_id string, expires_at long")
    assert alive == {r.session_id for r in chat.active(made, F.lit(7 * hour)).collect()} == {"a"}
