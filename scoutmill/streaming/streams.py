"""Continuous ingest, request statistics, progress and filtering.

Event time is ``ts``; the default watermark is ten minutes. Each stream has a
batch twin: the same function over a static frame.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from scoutmill.functions.text import clean_text, strip
from scoutmill.operators.corpus import filter_overlong
from scoutmill.operators.dedup import dedup_last
from scoutmill.operators.joins import answer_leaks
from scoutmill.operators.wanted import only_wanted
from scoutmill.operators.visits import visit_rows, visit_url_stats
from scoutmill.sources import readers

WATERMARK = "10 minutes"


def corpus_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New corpus files as cleaned rows; the checkpoint is the ledger of finished files."""
    raw = spark.readStream.schema(readers.CORPUS).option("maxFilesPerTrigger", files_per_batch).option(
        "columnNameOfCorruptRecord", readers.CORRUPT).json(path)
    return clean_rows(raw)


def clean_rows(raw: DataFrame) -> DataFrame:
    rows = raw.filter(F.col(readers.CORRUPT).isNull() & (strip(F.coalesce("text", F.lit(""))) != ""))
    url = F.coalesce("metadata.url", "id")
    return rows.select(F.substring(clean_text(url), 1, 1024).alias("url"), clean_text("metadata.title").alias("title"), clean_text("text").alias("text"))


def append_upserts(batch: DataFrame, batch_id: int, table: str, key: str = "url", order: str = "text") -> None:
    """Store one micro-batch of an upsert log: last row per key, in its own folder.

    A replayed batch overwrites its own folder, so the table stays right after
    a restart; nothing already stored is rewritten.
    """
    rows = dedup_last(batch.filter(F.coalesce(F.col(key), F.lit("")) != ""), [key], [order])
    rows.write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={batch_id}")


def current_table(spark: SparkSession, table: str, schema: str, key: str = "url") -> DataFrame:
    """The upsert log as a table: the row of the latest batch for each key, over the live levels and what came after them."""
    return dedup_last(_log(spark, table, schema, live_folders(spark, table)), [key], ["batch"]).drop("batch")


# ---- compaction of the upsert log ---------------------------------------

def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system Spark reads; none if it is missing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def _number(name: str, lead: str) -> int:
    return int(name.removeprefix(lead)) if name.startswith(lead) and name.removeprefix(lead).isdigit() else -1


def _manifest(spark: SparkSession, table: str) -> tuple[int, list[tuple[str, int, int, int]]]:
    """Latest whole manifest: its number, and (folder, level, first batch, last batch) of the compacted folders in order."""
    base = f"{table.rstrip('/')}/_manifests"
    whole = [n for name in _names(spark, base) if (n := _number(name, "v")) >= 0 and "_SUCCESS" in _names(spark, f"{base}/{name}")]
    if not whole:
        return -1, []
    rows = spark.read.schema("folder string, level int, first long, last long").json(f"{base}/v{max(whole)}").collect()  # a few folders per level
    return max(whole), sorted((tuple(r) for r in rows), key=lambda r: r[2])


def live_folders(spark: SparkSession, table: str) -> list[tuple[str, int, int, int]]:
    """Folders that make up the table: those of the manifest, and batches that no compaction has taken up yet."""
    _, merged = _manifest(spark, table)
    upto = max((r[3] for r in merged), default=-1)
    fresh = sorted(n for name in _names(spark, table) if (n := _number(name, "batch=")) > upto)
    return merged + [(f"batch={n}", 0, n, n) for n in fresh]


def _log(spark: SparkSession, table: str, schema: str, folders: list[tuple[str, int, int, int]]) -> DataFrame:
    base = table.rstrip("/")
    out = spark.createDataFrame([], f"{schema}, batch bigint")
    fresh = [f"{base}/{name}" for name, level, _, _ in folders if level == 0]
    if fresh:
        out = out.unionByName(spark.read.schema(f"{schema}, batch bigint").option("basePath", base).parquet(*fresh))
    merged = [f"{base}/{name}" for name, level, _, _ in folders if level > 0]
    return out.unionByName(spark.read.schema(f"{schema}, batch bigint").parquet(*merged)) if merged else out


def compact(spark: SparkSession, table: str, schema: str, key: str = "url", fanout: int = 10) -> int:
    """Merge every ``fanout`` neighbouring folders of a level into one of the next; returns the number of merges.

    A merged folder is written whole before a new manifest names it, so a
    reader sees the old set or the new one, and a compaction that dies leaves
    only an unnamed folder. What a manifest no longer names stays on disk until
    ``vacuum``. With n batches a reader meets fewer than ``fanout`` folders for
    each of log(n) levels.
    """
    base, merges = table.rstrip("/"), 0
    while True:
        number, _ = _manifest(spark, table)
        live = live_folders(spark, table)
        run = next((live[i : i + fanout] for i in range(len(live) - fanout + 1) if len({r[1] for r in live[i : i + fanout]}) == 1), None)
        if run is None:
            return merges
        name = f"merged-{run[0][1] + 1}-{run[0][2]}-{run[-1][3]}-{uuid.uuid4().hex[:8]}"
        rows = dedup_last(_log(spark, table, schema, run), [key], ["batch"])
        rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.parquet(f"{base}/{name}")
        first = live.index(run[0])
        kept = live[:first] + [(name, run[0][1] + 1, run[0][2], run[-1][3])] + live[first + fanout :]
        # Batches behind the last merged folder stay out: they are found by their number.
        upto = max(i for i, r in enumerate(kept) if r[1] > 0)
        spark.createDataFrame(kept[: upto + 1], "folder string, level int, first long, last long").coalesce(1).write.json(f"{base}/_manifests/v{number + 1}")
        merges += 1


def vacuum(spark: SparkSession, table: str) -> list[str]:
    """Delete folders that the current manifest has replaced, once no reader uses an older one; returns their names."""
    base, live = table.rstrip("/"), {r[0] for r in live_folders(spark, table)}
    dead = [n for n in _names(spark, table) if (n.startswith("merged-") or _number(n, "batch=") >= 0) and n not in live]
    for name in dead:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return dead


def ingest(stream: DataFrame, table: str, checkpoint: str, backfill: bool = True) -> StreamingQuery:
    """Upsert a stream of rows into a log table."""
    writer = stream.writeStream.foreachBatch(lambda df, i: append_upserts(df, i, table)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if backfill else writer.trigger(processingTime="30 seconds")).start()


def cache_misses(requests: DataFrame, corpus: DataFrame, url: str = "url", watermark: str = WATERMARK) -> DataFrame:
    """Requested URLs the corpus lacks, once each within the watermark (once each in a batch)."""
    known = only_wanted(corpus.select(url), requests, url).distinct()
    missing = requests.join(known, url, "left_anti")
    if not requests.isStreaming:
        return missing.dropDuplicates([url])
    return missing.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([url])


def windowed_stats(log: DataFrame, success: Column, stages: dict[str, Column], width: str = "3 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Requests, successes and mean stage latencies per tumbling window."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp"))
    if log.isStreaming:
        timed = timed.withWatermark("ts", watermark)
    stats = timed.groupBy(F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(success).alias("ok"), *[F.avg(c).alias(f"avg_{n}") for n, c in stages.items()])
    return stats.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests", "ok", *[f"avg_{n}" for n in stages])


class LateRows(StreamingQueryListener):
    """Rows that the watermark kept out of the windows, by query name.

    Register with ``spark.streams.addListener``. A row here is what reaches the
    state: late requests of one window and task arrive there as one.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event: Any) -> None:
        self.dropped.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event: Any) -> None:
        name = event.progress.name or str(event.progress.id)
        self.dropped[name] = self.dropped.get(name, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event: Any) -> None: ...

    def onQueryTerminated(self, event: Any) -> None: ...


def progress_stats(samples: DataFrame, width: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """Finished samples (ts, seconds, state, tool_calls) per window: count, success share, throughput, p50 and p95 of the durations.

    Durations are held as a quantile sketch of fixed size, which Spark merges
    across tasks and micro-batches; ``sketch`` merges further with ``merge_progress``.
    """
    timed = samples.withColumn("ts", F.col("ts").cast("timestamp"))
    if samples.isStreaming:
        timed = timed.withWatermark("ts", watermark)
    stats = timed.groupBy(F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("state") == "done").alias("done"), F.sum("tool_calls").alias("tool_calls"),
        F.kll_sketch_agg_double(F.col("seconds").cast("double")).alias("sketch"))
    span = F.unix_micros("w.end") - F.unix_micros("w.start")
    return stats.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "samples", (F.col("done") / F.col("samples")).alias("success_share"),
        (F.col("samples") * F.lit(1e6) / span).alias("samples_per_second"), "tool_calls", *_quantiles("sketch"), "sketch")


def _quantiles(sketch: str) -> list[Column]:
    return [F.kll_sketch_get_quantile_double(sketch, F.lit(q)).alias(name) for q, name in ((0.5, "p50"), (0.95, "p95"))]


def merge_progress(windows: DataFrame) -> DataFrame:
    """All windows of ``progress_stats`` as one row, from their sketches and counts."""
    done = F.sum(F.col("success_share") * F.col("samples"))
    whole = windows.agg(F.sum("samples").alias("samples"), (done / F.sum("samples")).alias("success_share"), F.sum("tool_calls").alias("tool_calls"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return whole.select("samples", "success_share", "tool_calls", *_quantiles("sketch"))


PROGRESS = "sample_id long, turns long, tool_calls long, failures long, seconds double, state string"
PROGRESS_STATE = "turns long, tool_calls long, failures long, started double, last double"


def rollout_progress(events: DataFrame, stalled_after: str = "10 minutes", watermark: str = WATERMARK) -> DataFrame:
    """One row per finished or stalled sample out of (sample_id, ts, kind), kind in turn, tool, failure, done.

    State is five numbers per open sample and expires by event time.
    """
    wait_ms = int(pd.Timedelta(stalled_after).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            turns, tools, failures, started, last = state.get
            state.remove()
            yield _progress_row(key, turns, tools, failures, last - started, "stalled")
            return
        turns, tools, failures, started, last = state.get if state.exists else (0, 0, 0, float("inf"), float("-inf"))
        done = False
        for b in batches:
            kinds = b["kind"].value_counts()
            turns += int(kinds.get("turn", 0))
            tools += int(kinds.get("tool", 0))
            failures += int(kinds.get("failure", 0))
            at = b["ts"].astype("int64") / (1e9 if b["ts"].dtype.str.endswith("[ns]") else 1e6)
            started, last = min(started, at.min()), max(last, at.max())
            done = done or bool(kinds.get("done", 0))
        if done:
            if state.exists:
                state.remove()
            yield _progress_row(key, turns, tools, failures, last - started, "done")
        else:
            state.update((turns, tools, failures, started, last))
            state.setTimeoutTimestamp(max(int(last * 1000) + wait_ms, state.getCurrentWatermarkMs() + 1))

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.groupBy("sample_id").applyInPandasWithState(update, PROGRESS, PROGRESS_STATE, "append", "EventTimeTimeout")


def _progress_row(key, turns, tools, failures, seconds, state) -> pd.DataFrame:
    return pd.DataFrame({"sample_id": [key[0]], "turns": [turns], "tool_calls": [tools], "failures": [failures], "seconds": [seconds], "state": [state]})


def finished_samples(events: DataFrame) -> DataFrame:
    """Batch twin of ``rollout_progress``: every sample of a finished log."""
    k = lambda name: F.count_if(F.col("kind") == name)
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    done = F.bool_or(F.col("kind") == "done")
    return events.groupBy("sample_id").agg(
        k("turn").alias("turns"), k("tool").alias("tool_calls"), k("failure").alias("failures"), (F.max(at) - F.min(at)).alias("seconds"),
        F.when(done, "done").otherwise("stalled").alias("state"))


def leak_filter(items: DataFrame, pages: DataFrame, out: str, checkpoint: str, max_rows: int = 10_000) -> StreamingQuery:
    """Label a stream of QA items against stored pages and write size-capped parts per label."""

    def write(batch: DataFrame, batch_id: int) -> None:
        answer_leaks(batch, pages).write.mode("overwrite").partitionBy("result").option("maxRecordsPerFile", max_rows).json(f"{out.rstrip('/')}/batch={batch_id}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def visit_stats_stream(rollouts: DataFrame) -> DataFrame:
    """Running URL classes per step (update or complete mode); ``rollouts`` is (step, output)."""
    visits = visit_rows(rollouts)
    return visit_url_stats(visits) if not rollouts.isStreaming else _per_step(visits)


def _per_step(visits: DataFrame) -> DataFrame:
    c = F.col("category")
    aggs = [F.count(F.lit(1)).alias("total_urls")] + [F.count_if(c == k).alias(k) for k in ("connect_fail", "browse_success", "browse_fail", "no_response")]
    return visits.groupBy("step").agg(*aggs, F.count_if(~c.isin("connect_fail", "no_response")).alias("valid_urls"))


def rollout_stream(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    """New rollout files as (step, output)."""
    raw = spark.readStream.schema("output string").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.jsonl").json(path)
    return raw.select(readers.file_stem(F.col("_metadata.file_path")).try_cast("int").alias("step"), "output").filter(F.col("step").isNotNull())


def grow_training_set(rows: DataFrame, prompt: str, most_tokens: int, table: str, checkpoint: str) -> StreamingQuery:
    """Append generated rows whose prompt fits the token limit."""
    return filter_overlong(rows, prompt, most_tokens).writeStream.format("parquet").option("path", table).option(
        "checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
