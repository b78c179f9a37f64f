from pyspark.sql import functions as F

from weftline.streaming import streams


def _run(df, name, spark, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_journal_and_duplicates(spark, tmp_path):
    rows = [("s", "/x", 1, "https://a/x", "h1", 0), ("s", "/x", 2, "https://b/x", "h2", 1), ("s", "/x", 3, "https://b/x", "h1", 0), ("s", "/y", 4, "https://a/y", "h4", 1)]
    df = spark.createDataFrame(rows, "scan_id string, sibling_key string, seq long, url string, hash string, fingerprint long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert _run(streams.exact_stream(stream), "exact_out", spark).count() == 3
    got = _run(streams.greedy_stream(stream), "greedy_out", spark)
    assert {r.seq: r.fate for r in got.collect()} == {1: "keep", 2: "mirror", 3: "exact", 4: "keep"}


def test_events(spark, tmp_path):
    rows = [("s", 1, "2024-01-01 00:00:00", "warn", {"url": "u", "reason": "r", "message": "m"}), (None, 2, "2024-01-01 00:00:01", "page", {})]
    df = spark.createDataFrame(rows, "scan_id string, seq long, ts string, type string, payload map<string,string>").withColumn("ts", F.to_timestamp("ts"))
    assert streams.warnings(df).first().url == "u"
    assert {r.scan_id for r in streams.stamped(df, "z").collect()} == {"s", "z"}
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    assert _run(streams.type_counts(stream), "counts_out", spark, "complete").count() == 2


def _through(spark, tmp_path, schema, batches, build):
    """What a stream over files, each a batch, gives in the end."""
    import json
    import os

    at = tmp_path / "in"
    os.makedirs(at)
    for i, rows in enumerate(batches):
        (at / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(at / f"{i}.json", (1000 + i, 1000 + i))
    out: list = []
    q = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(at))).writeStream.foreachBatch(lambda df, k: out.extend(df.collect())).outputMode("append").start()
    streams.stopped(q)
    return out


def test_pacing_over_batches(spark, tmp_path):
    row = lambda host, i, at: {"host": host, "i": i, "arrival_ms": at, "delay_ms": 100}
    batches = [[row("a", 0, 0), row("a", 1, 10), row("b", 0, 5)], [row("a", 2, 20), row("a", 3, 900)]]
    got = _through(spark, tmp_path, "host string, i long, arrival_ms long, delay_ms long", batches, streams.pacing_stream)
    assert sorted(map(tuple, got)) == [("a", 0, 0), ("a", 1, 100), ("a", 2, 200), ("a", 3, 900), ("b", 0, 5)]


def test_near_tier_over_batches(spark, tmp_path):
    row = lambda seq, key, url, digest, fp: {"scan_id": "s", "sibling_key": key, "seq": seq, "url": url, "hash": digest, "fingerprint": fp}
    batches = [[row(1, "/a", "u1", "h1", 0), row(2, "/a", "u2", "h2", 255)], [row(3, "/b", "u3", "h3", 1), row(4, "/c", "u4", "h1", 9), row(5, "/d", "u5", "h5", -1)]]
    schema = "scan_id string, sibling_key string, seq long, url string, hash string, fingerprint long"
    got = _through(spark, tmp_path, schema, batches, lambda df: streams.greedy_stream(df, near=2))
    assert {r.seq: r.fate for r in got} == {1: "keep", 2: "mirror", 3: "near", 4: "exact", 5: "keep"}
    assert {r.seq: r.sibling_key for r in got}[3] == "/b"


def test_events_and_journal_go_on_after_a_stop(spark, tmp_path):
    import json

    at = tmp_path / "events"
    at.mkdir()
    event = lambda i, kind: json.dumps({"scan_id": None, "seq": i, "type": kind, "payload": {"url": f"u{i}", "reason": "r", "message": "m"}})
    (at / "0.json").write_text(event(0, "warn") + "\n" + event(1, "page") + "\n{torn")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    start = lambda: streams.journal_sink(streams.warnings(streams.stamped(streams.event_stream(spark, str(at)), "s")), out, mark)
    streams.stopped(start())
    (at / "1.json").write_text(event(2, "warn"))
    streams.stopped(start())
    assert sorted((r.scan_id, r.url) for r in spark.read.json(out).collect()) == [("s", "u0"), ("s", "u2")]


def test_counts_recent_and_fan_out(spark, tmp_path):
    rows = [(i, "a" if i % 3 else "b") for i in range(30)]
    events = spark.createDataFrame(rows, "seq long, type string")
    assert [r.seq for r in streams.recent(events, 3).collect()] == [29, 28, 27]
    seen: list = []
    at = tmp_path / "in"
    events.coalesce(1).write.json(str(at))
    q = streams.fan_out(spark.readStream.schema("seq long, type string").json(str(at)), [lambda df, k: seen.append(df.count()), lambda df, k: seen.append(-df.count())], str(tmp_path / "mark"))
    streams.stopped(q)
    assert seen == [30, -30]
    q = streams.type_counts(spark.readStream.format("rate").option("rowsPerSecond", 5).load().selectExpr("timestamp AS ts", "'x' AS type"))
    assert q.columns == ["start", "type", "n"] and q.isStreaming


def test_journal_and_gaps_as_streams(spark, tmp_path):
    import json

    at = tmp_path / "journal"
    at.mkdir()
    (at / "0.json").write_text(json.dumps({"page": {"url": "https://s.example/a", "markdown": "m"}, "links": ["x"]}) + "\n{torn")
    assert [r.page.url for r in _run(streams.journal_stream(spark, str(at)), "journal_out", spark).collect()] == ["https://s.example/a"]
    at = tmp_path / "responses"
    times = ["2024-01-01 00:00:00.0", "2024-01-01 00:00:00.4", "2024-01-01 00:00:02.0", "2024-01-01 01:00:00.0"]
    df = spark.createDataFrame([("s", t) for t in times], "scan_id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(at))
    got = _run(streams.quiet_gaps(spark.readStream.schema(df.schema).parquet(str(at))), "gaps_out", spark, "append")
    assert sorted(r.n for r in got.collect()) == [1, 2]  # the last one may still go on
