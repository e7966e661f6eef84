"""Readers, writers, HTML, the API object and the streaming forms."""

import zipfile

from pyspark.sql import functions as F

from quiremill.api import Workshop
from quiremill.sinks import books
from quiremill.sources import files
from quiremill.sources.html import html_blocks, html_links, parse
from quiremill.streaming import rates


def test_html_blocks(spark):
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><li><a href="/x">X</a></ul></nav><div class="ad">buy</div><h1>Head</h1><p><b>One<br>two<p>Three<!-- no --></body>'
    got = [(t, x, a) for t, x, a in parse(page).blocks]
    assert got == [("title", "T", False), ("li", "X", True), ("div", "buy", True), ("h1", "Head", False), ("p", "One two", False), ("p", "Three", False)]
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    assert html_blocks(df).count() == 6 and [tuple(r) for r in html_links(df).collect()] == [(1, 0, "/x", "X")]


def test_files_round_trip(spark, tmp_path):
    parts = ["CHAPTER ONE\nA first line & more.\nSecond <line>.", "", "Another part\x02 here."]
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for kind, write in books.WRITERS.items():
        (tmp_path / "in" / f"An Author - A Book.{kind}").write_bytes(write("A Book", parts))
    (tmp_path / "in" / "sub" / "old.txt").write_bytes("ÖNSÖZ\n\nşiir  ve\nyazı\n\n12\n".encode("cp1254"))
    (tmp_path / "in" / "sub" / "tagged.md").write_text("#META# title :: Name\n#META#Header#End#\n### | One\n# first PageV01P002 words\n~~ go on\n### || Two\n", encoding="utf-8")
    (tmp_path / "in" / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "in" / "skip.bin").write_bytes(b"x")
    rows = {}
    for r in files.scan(spark, str(tmp_path / "in")).orderBy("path", "item_no").collect():
        rows.setdefault(r.path.rsplit("/", 1)[1], []).append((r.kind, r.level, r.text))
    assert rows["old.txt"] == [("heading", 1, "ÖNSÖZ"), ("p", 0, "şiir ve yazı")]
    assert rows["tagged.md"] == [("meta", 0, "title=Name"), ("heading", 1, "One"), ("p", 0, "first words go on"), ("page", 1, "2"), ("heading", 2, "Two")]
    assert rows["bad.docx"][0][0] == "error" and "skip.bin" not in rows
    for kind in ("docx", "epub", "html"):
        said = [t for k, _, t in rows[f"An%20Author%20-%20A%20Book.{kind}" if f"An%20Author%20-%20A%20Book.{kind}" in rows else f"An Author - A Book.{kind}"]]
        assert {"A first line & more.", "Second <line>."} <= set(said) and any("Another part" in x for x in said)
    listed = {r.ext: r for r in files.listing(spark, str(tmp_path / "in"), "*Book*").collect()}
    assert set(listed) == set(books.WRITERS) and {r.title for r in listed.values()} == {"A Book"}
    assert files.shelf(files.listing(spark, str(tmp_path / "in"), "*Book*")).select("formats").first()[0] == "docx+epub+html+txt"
    found = Workshop(spark).documents(str(tmp_path / "in"))
    assert found.count() == 6


def test_epub_is_sound():
    good = books.to_epub("T", ["Head\nbody", "x"])
    assert books.check_epub(good) == [] and books.to_epub("T", ["Head\nbody", "x"]) == good
    assert books.check_epub(b"junk") == ["not a zip file"] and books.check_epub(None)
    assert zipfile.ZipFile(__import__("io").BytesIO(good)).namelist()[0] == "mimetype"
    assert books.fold_note_marks("ab{{n0001}}c{{n0002}}") == [(2, "n0001"), (3, "n0002")]


def test_catalogue(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("id\tauthor\ttitle\tstatus\ttok_length\n1\tKhalid\tShahname\tpri\t10\n2\tHalid\tSahname\tpri\tx\n3\tHalid\tSahname\tsec\t5\n", encoding="utf-8")
    c = files.catalogue(spark, str(tmp_path / "c.tsv"))
    assert [r.id for r in files.search_catalogue(c, "halid").collect()] == ["1", "2"]
    assert files.search_catalogue(c, "halid nobody").count() == 0


def test_api(spark):
    w = Workshop(spark)
    old = spark.createDataFrame([(1, "one,two"), (2, "same")], "doc_id long, text string")
    new = w.repair(old)
    got = {r.doc_id: (r.state, r.changes) for r in w.compare(old, new).collect()}
    assert got[2] == ("same", None) and got[1][0] == "changed" and got[1][1][0]["new"] == "one, two"
    assert w.chunk(old, 3).count() == 2 and w.report(old).count() == 2
    made = w.publish(spark.createDataFrame([(1, 0, "T", "x"), (1, 1, "T", None)], "job_id long, idx long, title string, text string")).collect()
    assert {r.format for r in made} == {"txt", "epub"}


def stream_of(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def run(df, spark, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_debounce_streams_as_in_batch(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{m:02d}:00") for m in (0, 1, 2, 10, 11)] + [(2, "2024-01-01 00:05:00"), (3, "2024-01-02 00:00:00")]
    s = stream_of(spark, tmp_path, rows, "doc_id long, ts string")
    got = run(rates.debounce(s.withWatermark("ts", "1 minute"), ["doc_id"], "ts"), spark, tmp_path, "bursts", "append")
    assert sorted((r.doc_id, r.n) for r in got.collect()) == [(1, 2), (1, 3), (2, 1)]  # the last burst still waits for its watermark


def test_tumbling_stream(spark, tmp_path):
    rows = [(k, f"2024-01-01 0{h}:30:00") for k, h in ((1, 0), (1, 0), (2, 1))]
    s = stream_of(spark, tmp_path, rows, "k long, ts string")
    got = run(rates.tumbling(s, ["k"], "ts", "1 hour", F.count("*").alias("n")), spark, tmp_path, "hours", "complete")
    assert sorted((r.k, r.n) for r in got.collect()) == [(1, 2), (2, 1)]


def test_lane_state_stream(spark, tmp_path):
    rows = [(1, "done", 0, "2024-01-01 00:00:01"), (1, "cancel", 0, "2024-01-01 00:00:02"), (1, "done", 0, "2024-01-01 00:00:03"), (2, "done", 0, "2024-01-01 00:00:01")]
    s = stream_of(spark, tmp_path, rows, "doc_id long, kind string, generation int, ts string")
    got = run(rates.lanes(s), spark, tmp_path, "lanes", "update")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1, 1), (2, 0, 1, 0)]


def test_quota_day_is_local(spark):
    rows = [("m", "2024-03-10 07:59:59"), ("m", "2024-03-10 08:00:00"), ("m", "2024-03-11 06:59:59"), ("m", "2024-03-11 07:00:00")]
    df = spark.createDataFrame(rows, "model string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.day, r.n) for r in rates.quota_day(df, "model", "ts").collect()) == [("2024-03-09", 1), ("2024-03-10", 2), ("2024-03-11", 1)]


def test_covers():
    import numpy as np

    from quiremill.sinks import covers

    one = covers.make_cover("A Title", "Me")
    assert one[:8] == b"\x89PNG\r\n\x1a\n" and one == covers.make_cover("A Title", "Me") != covers.make_cover("B", "Me")
    assert not covers.has_contrast(np.full((9, 9), 250)) and covers.has_contrast(np.arange(81).reshape(9, 9) * 3)


def test_spans_and_stages(spark):
    from quiremill.operators import audit

    df = spark.createDataFrame([("abcdefgh", [(5, 2), (1, 2), (2, 3)]), ("xy", [])], "c string, s array<struct<start:int,size:int>>")
    assert [r[0] for r in df.select(audit.wrap_spans(F.col("c"), F.col("s"), "<", ">")).collect()] == ["a<bc>de<fg>h", "xy"]
    rows = spark.createDataFrame([(1, y, i) for y, i in enumerate([0.1, 0.9, 0.0, 0.9, 0.9, 0.0])], "k long, y long, ink double")
    assert [r.y for r in audit.ruled_lines(rows, ["k"], "y", "ink").collect()] == [1]
    no = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 3, 7, 6, 5])], "k long, at long, n long")
    assert [r.n for r in audit.falling_to_null(no, ["k"], "at", "n").orderBy("at").collect()] == [5, None, 7, 6, 5]


def test_names_dont_collide():
    import importlib.util

    from quiremill.plans import ALL

    if importlib.util.find_spec("quiremill.llm"):
        from quiremill.llm.queries import QUERIES

        assert not set(ALL) & set(QUERIES)
