"""Sources, sinks and streams on small files."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from atrament.sources import readers, writers
from atrament.streaming import workers


def test_jsonl_keeps_other_separators(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "text": "a\u2028b"}\n{"id": "2", "text": "c"}\n', encoding="utf-8")
    rows = readers.jsonl(spark, str(p), "id string, text string").orderBy("id").collect()
    assert [r.text for r in rows] == ["a\u2028b", "c"] and rows[0].source_path.endswith("a.jsonl")
    p.write_text('{"id": "1", "id": "2"}\n', encoding="utf-8")
    with pytest.raises(Exception, match="strict"):
        readers.jsonl(spark, str(p), "id string").collect()
    writers.write_jsonl(spark.createDataFrame([("ż", None)], "a string, b string"), str(tmp_path / "out"))
    assert readers.jsonl(spark, str(tmp_path / "out"), "a string, b string").first()["a"] == "ż"
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_jsonl(spark.range(1), str(tmp_path / "out"))


def test_words_and_lines(spark, tmp_path):
    from atrament.operators.layout import word_lines

    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "w.tsv").write_text(head + "4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n5\t1\t1\t1\t1\t2\t20\t5\t10\t8\t80\tb\"\n5\t1\t1\t1\t1\t1\t5\t6\t10\t8\t90.5\ta\n")
    line = word_lines(readers.word_table(spark, str(tmp_path / "w.tsv"))).first()
    assert (line.box, line.min_confidence, line.text) == ([5, 5, 30, 14], 80.0, 'a b"')


def test_page_documents(spark, tmp_path):
    doc = '<P xmlns="x"><R><RegionRefIndexed index="0" regionRef="b"/><RegionRefIndexed index="1" regionRef="a"/></R><TextRegion id="a"><Coords points="0,0 9,5"/><TextEquiv><Unicode>drugi</Unicode></TextEquiv></TextRegion><TextRegion id="b"><Coords points="1,1 4,4"/><TextLine><TextEquiv><Unicode>pierwszy</Unicode></TextEquiv></TextLine></TextRegion></P>'
    (tmp_path / "p.xml").write_text(doc)
    rows = readers.page_xml(spark, str(tmp_path / "p.xml")).orderBy("region_index").collect()
    assert [(r.id, r.text, r.box) for r in rows] == [("b", "pierwszy", [1, 1, 4, 4]), ("a", "drugi", [0, 0, 9, 5])]
    alto = '<alto><TextLine BASELINE="5"><String CONTENT="a"/><String CONTENT="b"/></TextLine><TextLine><String CONTENT="c"/></TextLine></alto>'
    got = spark.createDataFrame([(alto,), ("<broken",)], "x string").select(readers.alto_text("x").alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("a b\nc", 2, 1), ("", 0, 0)]


def test_pairs_archives_and_ranges(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.png").write_bytes(b"x")
    (tmp_path / "d" / "a.txt").write_text("wiersz")
    (tmp_path / "d" / "b.txt").write_text(" ")
    got = {r.stem: (r.image_sha256 is not None, r.text) for r in readers.pairs(spark, str(tmp_path / "d")).collect()}
    assert got == {"a": (True, "wiersz"), "b": (False, None)} and readers.tree_digest(spark, str(tmp_path / "d")).count() == 3
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("ok.txt", "1")
        f.writestr("../up.txt", "2")
    with tarfile.open(fileobj=t, mode="w") as f:
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        f.addfile(link)
    rows = spark.createDataFrame([(z.getvalue(),), (t.getvalue(),)], "c binary").select(F.explode(readers.archive_members("c")).alias("m")).select("m.*").collect()
    assert {r.member: r.safe for r in rows} == {"ok.txt": True, "../up.txt": False, "l": False}
    assert spark.range(1).select(readers.page_numbers(F.lit("1-3,5")).alias("p")).first().p == [1, 2, 3, 5]
    assert spark.range(1).select(readers.proof_level(F.lit('<pagequality level="1"/><pagequality level="4"/>')).alias("p")).first().p == 4


def test_pack_and_release(spark, tmp_path):
    order = spark.createDataFrame([(0, "b"), (1, "a")], "pos int, id string")
    pred = spark.createDataFrame([("a", "ok", "x\ty"), ("b", "error", "zz")], "id string, status string, text string")
    cells = writers.pack_cells(order, pred)
    assert [r.cell for r in cells.collect()] == ["", "x\\ty"] and {r.id: r.text for r in writers.unpack_cells(order, cells).collect()} == {"a": "x\ty", "b": ""}
    writers.release({"train": pred, "test": pred}, {"train": "public", "test": "private"}, ["text"], str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "test")).columns == ["id", "status"]
    assert writers.labelled_union({"a": pred, "b": order}).count() == 4


def test_prediction_log_resumes(spark, tmp_path):
    src, sink = tmp_path / "src", str(tmp_path / "sink")
    schema = "id string, text string"
    spark.createDataFrame([("1", "a"), ("2", "bad")], schema).write.parquet(str(src))

    def predict(s):
        if s.iloc[0] == "bad":
            raise ValueError("no")
        return s.str.upper()

    def run(checkpoint):
        stream = spark.readStream.schema(schema).parquet(str(src))
        workers.predictions_log(stream, predict, sink, str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(sink).collect())

    assert run("c1") == [("1", "ok", "A", None), ("2", "error", "", "ValueError")]
    spark.createDataFrame([("3", "c")], schema).write.mode("append").parquet(str(src))
    assert run("c2") == [("1", "ok", "A", None), ("2", "error", "", "ValueError"), ("3", "ok", "C", None)]


def test_windows_of_a_stream(spark, tmp_path, data):
    ev = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = workers.event_windows(stream, "ts", "event_type", "1 hour", late="10 minutes").writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.start, r.event_type): r.n for r in workers.event_windows(ev, "ts", "event_type", "1 hour").collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("win").collect()} == want
    assert workers.sessions(ev, "ts", "user_id", "30 minutes").agg(F.sum("n")).first()[0] == ev.count()


def test_events_fold_to_a_state(spark, tmp_path):
    ev = spark.createDataFrame([("p", "a", "b", "2026-01-01 00:00:00"), ("p", "b", "c", "2026-01-01 00:01:00"), ("p", "x", "d", "2026-01-01 00:02:00")], "page_id string, before string, after string, t string").select("page_id", "before", "after", F.to_timestamp("t").alias("timestamp"))
    ev.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "log"))
    q = workers.fold_events(stream).writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("folded").first()
    assert (r.text, r.events, r.breaks) == ("d", 3, 1)


def test_retries_wait_twice_as_long():
    from atrament.streaming.workers import with_retries

    seen, waits = [], []

    def call(x):
        seen.append(x)
        if len(seen) < 3:
            raise TimeoutError
        return x

    assert with_retries(call, sleep=waits.append)(7) == 7 and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        with_retries(lambda: int("x"), sleep=waits.append)()
