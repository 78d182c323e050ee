"""Streams equal their batch twins; late and repeated data behave."""

import datetime as dt
import json

from pyspark.sql import functions as F

from scoutmill.operators.joins import answer_leaks
from scoutmill.streaming import streams as S

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_ingest_upserts_and_replays(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    write = lambda name, rows: (src / name).write_text("\n".join(json.dumps(r) for r in rows))
    write("1.jsonl", [{"id": "a", "text": "one"}, {"id": "b", "text": "two"}, {"id": "c", "text": " "}])
    run = lambda: S.ingest(S.corpus_stream(spark, str(src), 1), table, str(tmp_path / "ck")).awaitTermination()
    run()
    write("2.jsonl", [{"id": "b", "text": "newer"}, {"id": "d", "text": "four"}])
    run()
    now = lambda: {(r.url, r.text) for r in S.current_table(spark, table, "url string, title string, text string").collect()}
    want = {("a", "one"), ("b", "newer"), ("d", "four")}
    assert now() == want
    S.append_upserts(spark.createDataFrame([("b", "", "newer"), ("d", "", "four")], "url string, title string, text string"), 1, table)
    assert now() == want


def stream(spark, tmp_path, df, name):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_cache_misses(spark, tmp_path):
    rows = spark.createDataFrame([("u1", at(1)), ("u2", at(2)), ("u2", at(3)), ("u3", at(4))], "url string, ts timestamp")
    corpus = spark.createDataFrame([("u1",)], "url string")
    q = S.cache_misses(stream(spark, tmp_path, rows, "r"), corpus).writeStream.format("memory").queryName("misses").outputMode("append").start()
    drain(q)
    assert sorted(r.url for r in spark.table("misses").collect()) == ["u2", "u3"] == sorted(r.url for r in S.cache_misses(rows, corpus).collect())


def test_windows_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(at(i * 1.7), i % 3 != 0, float(i)) for i in range(20)], "ts timestamp, ok boolean, s double")
    args = (F.col("ok"), {"search": F.col("s")})
    q = S.windowed_stats(stream(spark, tmp_path, rows, "w"), *args).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    drain(q)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, S.windowed_stats(rows, *args).collect()))


def test_progress(spark, tmp_path):
    def rows(items):
        return spark.createDataFrame([(s, at(t), k) for s, t, k in items], "sample_id long, ts timestamp, kind string").coalesce(1)

    first = rows([(1, 0, "turn"), (1, 5, "tool"), (2, 1, "turn"), (1, 9, "done")])
    path = tmp_path / "p"
    first.write.parquet(str(path))
    q = S.rollout_progress(spark.readStream.schema(first.schema).parquet(str(path))).writeStream.format("memory").queryName("progress").outputMode("append").start()
    q.processAllAvailable()
    # Much later events move the watermark past sample 2's deadline.
    rows([(3, 7200, "turn")]).write.mode("append").parquet(str(path))
    q.processAllAvailable()
    rows([(3, 7300, "done")]).write.mode("append").parquet(str(path))
    drain(q)
    got = {r.sample_id: (r.turns, r.tool_calls, r.seconds, r.state) for r in spark.table("progress").collect()}
    assert got[1] == (1, 1, 9.0, "done") and got[2] == (1, 0, 0.0, "stalled") and got[3] == (1, 0, 100.0, "done")
    twin = {r.sample_id: r.state for r in S.finished_samples(spark.read.parquet(str(path))).collect()}
    assert twin == {1: "done", 2: "stalled", 3: "done"}


def test_leak_filter_equals_batch(spark, tmp_path):
    items = spark.createDataFrame([("q1", "blue whale", "u1"), ("q2", "red fox", "u1"), ("q3", "x", "gone")], "question string, answer string, url string")
    pages = spark.createDataFrame([("u1", "A blue whale swam.")], "url string, markdown string")
    S.leak_filter(stream(spark, tmp_path, items, "i"), pages, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.question, r.result, r.reason) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {(r.question, r.result, r.reason) for r in answer_leaks(items, pages).collect()} == {
        ("q1", "negative", "answer_found"), ("q2", "positive", "answer_not_found"), ("q3", "positive", "no_page")}


def test_visits_per_step(spark, tmp_path):
    src = tmp_path / "v"
    src.mkdir()
    call = '<tool_call>{"name": "visit", "arguments": {"url": ["a", "b"]}}</tool_call>'
    (src / "1.jsonl").write_text(json.dumps({"output": call + "<tool_response>ok</tool_response>"}) + "\n" + json.dumps({"output": call}))
    (src / "2.jsonl").write_text(json.dumps({"output": call + call + "<tool_response>timed out</tool_response>"}))
    (src / "x.jsonl").write_text(json.dumps({"output": call}))
    q = S.visit_stats_stream(S.rollout_stream(spark, str(src), 1)).writeStream.format("memory").queryName("visits").outputMode("complete").start()
    drain(q)
    got = {r.step: (r.total_urls, r.browse_success, r.no_response, r.connect_fail, r.valid_urls) for r in spark.table("visits").collect()}
    assert got == {1: (4, 2, 2, 0, 2), 2: (4, 0, 0, 4, 0)}
    static = spark.createDataFrame([(1, call + "<tool_response>ok</tool_response>"), (1, call), (2, call + call + "<tool_response>timed out</tool_response>")], "step int, output string")
    twin = {r.step: (r.total_urls, r.browse_success, r.no_response, r.connect_fail, r.valid_urls) for r in S.visit_stats_stream(static).collect() if r.step is not None}
    assert twin == got


def test_growing_set(spark, tmp_path):
    rows = spark.createDataFrame([("a b c",), ("a b c d e",)], "prompt string")
    S.grow_training_set(stream(spark, tmp_path, rows, "g"), "prompt", 4, str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    assert [r.prompt for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["a b c"]


UPSERTS = "url string, title string, text string"


def upsert(spark, table, batch_id, rows):
    S.append_upserts(spark.createDataFrame([(u, "", t) for u, t in rows], UPSERTS), batch_id, table)


def test_compaction_keeps_the_table_and_bounds_its_folders(spark, tmp_path):
    table, want = str(tmp_path / "log"), {}
    rows = lambda: {r.url: r.text for r in S.current_table(spark, table, UPSERTS).collect()}
    for i in range(14):
        fresh = {f"u{(i * 3 + k) % 11}": f"v{i}" for k in range(3)}
        upsert(spark, table, i, fresh.items())
        want |= fresh
        if i % 5 == 4:
            S.compact(spark, table, UPSERTS, fanout=3)
            assert rows() == want
    S.compact(spark, table, UPSERTS, fanout=3)
    live = S.live_folders(spark, table)
    assert rows() == want and [r[1] for r in live] == sorted((r[1] for r in live), reverse=True) and len(live) <= 2 * 3
    assert [r[2] for r in live[1:]] == [r[3] + 1 for r in live[:-1]] and live[-1][3] == 13
    # A batch that is stored again after it was merged changes nothing; old folders go on request.
    upsert(spark, table, 0, [("u0", "replayed")])
    assert rows() == want
    assert len(S.vacuum(spark, table)) >= 9 and rows() == want and S.vacuum(spark, table) == []


def test_a_compaction_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "log")
    for i in range(3):
        upsert(spark, table, i, [("a", f"v{i}"), (f"b{i}", "x")])
    before = S.live_folders(spark, table)
    rows = lambda: sorted(map(tuple, S.current_table(spark, table, UPSERTS).collect()))
    want = rows()

    class Broken:
        """Stands where the manifest would be written."""

        def index(self, _):
            raise RuntimeError("killed")

    monkeypatch.setattr(S, "live_folders", lambda spark, table, f=S.live_folders: type("L", (list,), {"index": Broken().index})(f(spark, table)))
    try:
        S.compact(spark, table, UPSERTS, fanout=3)
        raise AssertionError("was not killed")
    except RuntimeError as error:
        assert str(error) == "killed"
    monkeypatch.undo()
    assert any(n.startswith("merged-") for n in S._names(spark, table)) and S.live_folders(spark, table) == before and rows() == want
    assert S.compact(spark, table, UPSERTS, fanout=3) == 1 and rows() == want
    assert len(S.vacuum(spark, table)) == 4  # three batches and the unnamed folder


def test_late_requests_are_counted(spark, tmp_path):
    log = lambda times: spark.createDataFrame([(at(t), True, 1.0) for t in times], "ts timestamp, ok boolean, s double").coalesce(1)
    path = tmp_path / "log"
    listener = S.LateRows()
    spark.streams.addListener(listener)
    try:
        log([0, 1]).write.parquet(str(path))
        stats = S.windowed_stats(spark.readStream.schema("ts timestamp, ok boolean, s double").parquet(str(path)), F.col("ok"), {"all": F.col("s")}, watermark="1 minute")
        q = stats.writeStream.format("memory").queryName("late").outputMode("append").start()
        q.processAllAvailable()
        log([3600]).write.mode("append").parquet(str(path))
        q.processAllAvailable()
        log([30, 60, 3601]).write.mode("append").parquet(str(path))  # two windows long closed
        q.processAllAvailable()
        log([7200]).write.mode("append").parquet(str(path))
        drain(q)
        import time

        for _ in range(50):
            if listener.dropped.get("late"):
                break
            time.sleep(0.1)
        assert listener.dropped["late"] == 2
    finally:
        spark.streams.removeListener(listener)


def test_progress_stats_equal_batch_within_the_sketch(spark, tmp_path):
    rows = spark.range(4000).select((F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.col("id") / 20)).alias("ts"), (F.pmod(F.col("id") * 7919, F.lit(1000)) / 10).alias("seconds"),
                                    F.when(F.col("id") % 4 == 0, "stalled").otherwise("done").alias("state"), (F.col("id") % 3).alias("tool_calls"))
    path = tmp_path / "s"
    rows.repartition(6).write.parquet(str(path))
    q = S.progress_stats(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(path))).writeStream.format("memory").queryName("stats").outputMode("complete").start()
    drain(q)
    exact = {r.w.start: r for r in rows.groupBy(F.window("ts", "1 minute").alias("w")).agg(
        F.count("*").alias("n"), F.avg((F.col("state") == "done").cast("int")).alias("share"), F.percentile("seconds", 0.5).alias("p50"), F.percentile("seconds", 0.95).alias("p95")).collect()}
    got, twin = spark.table("stats").collect(), {r.window_start: r for r in S.progress_stats(rows).collect()}
    assert len(got) == len(exact) == len(twin) == 4
    for r in got:
        e = exact[r.window_start]
        assert (r.samples, r.success_share, r.samples_per_second) == (e.n, e.share, e.n / 60) == (twin[r.window_start].samples, twin[r.window_start].success_share, twin[r.window_start].samples_per_second)
        for name, value in (("p50", e.p50), ("p95", e.p95)):
            assert abs(r[name] - value) <= 3 and abs(twin[r.window_start][name] - value) <= 3  # three hundredths of the range
    whole = S.merge_progress(spark.table("stats")).first()
    assert whole.samples == 4000 and whole.success_share == 0.75 and abs(whole.p50 - 50) <= 3 and abs(whole.p95 - 95) <= 3
