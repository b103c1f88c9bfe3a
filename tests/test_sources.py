from pyspark.sql import functions as F

from quarry.sources import listing, packets, store
from quarry.streaming import activity, discovery


def test_anchors_are_made_absolute_and_the_last_wins(spark):
    html = '<a href="/a_08122026-x.pdf">Agenda one</a> <a class="c" href="http://y.example/b">Old</a> <a href="/a_08122026-x.pdf">Agenda <b>two</b></a>'
    pages = spark.createDataFrame([(html,)], "html string")
    got = {r["url"]: (r["title"], r["kind"], str(r["day"])) for r in listing.anchors(pages, "https://x.example/").collect()}
    assert got == {"https://x.example/a_08122026-x.pdf": ("Agenda two", "agenda", "2026-08-12"), "http://y.example/b": ("Old", "previous_versions", "None")}


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>http://x.example/1</link><pubDate>Wed, 05 Mar 2025 10:00:00 GMT</pubDate></item></channel></rss>")
    row = listing.feed(spark, str(tmp_path)).first()
    assert (row["title"], row["url"], str(row["day"])) == ("A", "http://x.example/1", "2025-03-05")


def test_binary_packets_and_failing_extractor(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 one\ftwo")
    (tmp_path / "b.pdf").write_bytes(b"nope")
    files = packets.read_binary(spark, str(tmp_path))
    assert {r["path"][-5:]: r["ok"] for r in files.select("path", packets.is_pdf(F.col("content")).alias("ok")).collect()} == {"a.pdf": True, "b.pdf": False}

    def extract(content):
        if not content.startswith(b"%PDF"):
            raise ValueError("no PDF")
        return content.decode().split("\f")

    got = {r["path"][-5:]: (r["text"], r["error"]) for r in packets.parse(files, extract).select("path", packets.join_pages(F.col("pages")).alias("text"), "error").collect()}
    assert got["a.pdf"] == ("\n--- PAGE 1 ---\n\n%PDF-1.4 one\n\n--- PAGE 2 ---\n\ntwo", None)
    assert got["b.pdf"][1] == "ValueError: no PDF"


def test_table_upsert_and_versions(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), "k string, n int")
    assert t.read().count() == 0
    status = t.upsert(spark.createDataFrame([("a", 1), (None, 2), ("a", 3)], "k string, n int"), "k", F.col("n"))
    assert (status.status, status.written, status.skipped) == ("synced", 2, 1)
    t.upsert(spark.createDataFrame([("b", 5)], "k string, n int"), "k", F.col("n"))
    assert sorted(map(tuple, t.read().collect())) == [("a", 3), ("b", 5)]
    v = store.Table(spark, str(tmp_path / "v"))
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "k string, at int")
    v.append_versions(rows, "k", F.col("at"))
    v.append_versions(rows, "k", F.col("at"))
    assert sorted(r["version"] for r in v.read().collect()) == [1, 2, 3, 4]
    assert v.latest("k").first()["version"] == 4


def test_best_effort_and_fallback(spark, tmp_path):
    assert store.best_effort(False, lambda: 1 / 0).status == "disabled"
    assert store.best_effort(True, lambda: 1 / 0).error.startswith("ZeroDivisionError")
    empty = store.read_json_or_empty(spark, str(tmp_path / "none.json"), "k string")
    some = spark.createDataFrame([("x",)], "k string")
    assert store.primary_or_fallback(empty, some).first()["source"] == "file"
    row = store.lead_rows(spark.createDataFrame([("x", None)], "k string, tags array<string>"), ("tags",)).first()
    assert row["tags"] == [] and row["record"] == '{"k":"x","tags":[]}'


def test_discovery_is_idempotent(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "1.json").write_text('{"url":"u1","title":"a","kind":"agenda"}\n{"url":"u2","title":"b","kind":"other"}\n{"url":"u1","title":"a2","kind":"agenda"}\n{"url":null,"title":"c","kind":"agenda"}\n')
    registry = store.Table(spark, str(tmp_path / "registry"), discovery.REGISTRY)
    seen = []

    def process(waiting):
        seen.extend(r["url"] for r in waiting.collect())
        return waiting.select("url", F.when(F.col("url") == "u3", "broken").alias("error"))

    run = lambda n: discovery.discover(spark, str(pages), "url string, title string, kind string", registry, process, str(tmp_path / f"c{n}")).awaitTermination()
    run(1)
    run(2)  # a fresh checkpoint reads all files again; the registry keeps them from being ingested twice
    (pages / "2.json").write_text('{"url":"u3","title":"d","kind":"packet"}\n')
    run(2)
    assert seen.count("u1") == 1 and "u2" not in seen
    assert {r["url"]: r["status"] for r in registry.read().collect()} == {"u1": "ingested", "u2": "discovered", "u3": "failed"}


def test_stream_states_equal_the_fold(spark, small):
    from quarry.operators import lifecycle as L
    from quarry.operators import rows as R
    from quarry.session import load

    out = activity.run_to_files(activity.states(activity.read_events(spark, small)), "update")
    stream = {r["user_id"]: (r["state"], r["events"]) for r in R.last_wins(out, F.col("user_id"), F.col("events"), keep_keyless=False).collect()}
    named = F.try_element_at(F.create_map(*[F.lit(x) for x in L.EVENTS_TO_STATES]), F.col("event_type"))
    batch = {r["user_id"]: (r["state"], r["events"]) for r in L.fold_states(load(spark, small, "events").withColumn("event", named), "user_id", ["ts", "event_id"], "event").collect()}
    assert stream == batch and stream


def test_windows_over_a_stream(spark, small):
    e = activity.read_events(spark, small)
    out = activity.run_to_files(activity.windowed(e).select("event_type", "events"), "update")
    assert out.count() > 0
