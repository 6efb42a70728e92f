"""Live jobs: ingest with rollups, alert evaluation, baseline learning."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weirmark.functions.timeslot import DAY, MINUTE, to_epoch
from weirmark.operators import alerts, enrich, prefix, rollup, versions
from weirmark.operators.detect import BASELINE_DAYS, LONG_MINUTES, MAX_DURATION, Moment
from weirmark.operators.retention import KEEP
from weirmark.sources.tables import MERGED, Store


@dataclass
class Dimensions:
    """Functions that read the dimension tables as they are now.

    They are called for every micro-batch and evaluation, so a changed rule
    takes effect with the next one. ``versions`` reads the history of the rules, for
    evaluations of a past span by the rules of each minute.
    """

    routers: Callable[[], DataFrame]
    rules: Callable[[], DataFrame]
    protocols: Callable[[], DataFrame]
    versions: Callable[[], DataFrame] | None = None


def refresh_ranges(store: Store, dims: Dimensions) -> None:
    """Replace the stored prefix ranges by those of the present rules."""
    store.replace("prefixes_range", prefix.prefix_ranges(dims.rules()))


def ingest_batch(
    store: Store, dims: Dimensions, flows: DataFrame, batch_id: int, stream: str = "batch"
) -> None:
    """Enrich one micro-batch and append facts and rollup partials.

    Rollups read the facts back, so the enrichment runs once, nothing has to
    stay cached and a lost executor costs a re-read. Each table's part carries
    the ids of stream and batch: a batch delivered twice replaces itself and
    no other. The tables are published after the last one is written. Flows whose
    totals exceed 64 bits are also kept apart.
    """
    part = f"{stream}.{batch_id}"
    index = prefix.index_prefixes(prefix.prefix_ranges(dims.rules()))
    raw = enrich.enrich_flows(flows, dims.routers(), index, dims.protocols())
    written = [store.write("raw", raw, part)]
    stored = store.read_written(written[0])
    for name, rows in (
        ("raw_out_of_range", enrich.out_of_range(stored)),
        ("prefixes_total_1m", rollup.prefix_totals(stored)),
        ("prefixes_src_profile_10m", rollup.source_profile(stored)),
        ("prefixes_proto_profile_1m", rollup.class_profile(stored)),
    ):
        written.append(store.write(name, rows, part))
    store.publish(*written)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in a stream's checkpoint; a new checkpoint has a new one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def start_ingest(
    flows: DataFrame, store: Store, dims: Dimensions, checkpoint: str, **trigger
) -> StreamingQuery:
    """Run :func:`ingest_batch` on a stream of flow messages."""
    return (
        flows.writeStream.foreachBatch(
            lambda batch, batch_id: ingest_batch(
                store, dims, batch, batch_id, stream_id(store.spark, checkpoint)
            )
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )


def watermarked_totals(tagged: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Streaming totals with bounded state, for a stream of tagged flows.

    The stored partials accept rows of any age; this form drops rows later
    than ``lateness`` and keeps its open minutes in the state store.
    """
    return (
        tagged.withWatermark("time_received", lateness)
        .select("time_received", F.explode("prefixes").alias("prefix"), "total_bytes", "total_packets")
        .groupBy("prefix", F.window("time_received", "1 minute"))
        .agg(
            F.try_sum("total_bytes").alias("bytes"),
            F.try_sum("total_packets").alias("packets"),
            F.count("*").alias("flows"),
        )
        .select("prefix", F.col("window.start").alias("time_received"), "bytes", "packets", "flows")
    )


def learn_baseline(store: Store, day: Moment) -> None:
    """Baseline of one closed UTC day; learning a day again replaces it."""
    start = to_epoch(day) // DAY * DAY
    profile = store.read("prefixes_proto_profile_1m", start, start + DAY - 1)
    store.append(
        "prefixes_proto_profile_1d", rollup.daily_baseline(profile, start), f"day.{start // DAY}"
    )


def daily_upkeep(store: Store, now: Moment = None) -> None:
    """Once a day: merge and learn the day before, drop what has expired. May be repeated."""
    now = to_epoch(now)
    yesterday = now // DAY - 1
    for name in MERGED:
        store.merge_day(name, yesterday)
    learn_baseline(store, yesterday * DAY)
    for name in KEEP:
        store.drop_expired(name, now)


def evaluate(
    store: Store,
    dims: Dimensions,
    as_of: Moment = None,
    outbox: str | None = None,
    max_duration: int = MAX_DURATION,
) -> None:
    """One evaluation of all logged detectors, appended under its own time."""
    now = to_epoch(as_of)
    rules = dims.rules()
    look_back = max(LONG_MINUTES, max_duration) * MINUTE
    totals = store.read("prefixes_total_1m", now - look_back - MINUTE, now)
    profile = store.read("prefixes_proto_profile_1m", now - MINUTE, now)
    baseline = store.read("prefixes_proto_profile_1d", now - (BASELINE_DAYS + 1) * DAY, now)
    _log(
        store,
        f"at.{now}",
        alerts.threshold_alert_log(totals, rules, now, max_duration),
        alerts.ddos_alert_log(profile, baseline, rules, now),
        outbox,
    )


def evaluate_span(
    store: Store,
    dims: Dimensions,
    start: Moment,
    end: Moment,
    outbox: str | None = None,
    max_duration: int = MAX_DURATION,
) -> None:
    """An evaluation for every minute from ``start`` to ``end``, in one job.

    By the rules in force at each minute if their versions are known, else by those of now.
    """
    first, last = to_epoch(start) // MINUTE * MINUTE, to_epoch(end) // MINUTE * MINUTE
    look_back = max(LONG_MINUTES, max_duration) * MINUTE
    totals = store.read("prefixes_total_1m", first - look_back - MINUTE, last + MINUTE - 1)
    profile = store.read("prefixes_proto_profile_1m", first - MINUTE, last + MINUTE - 1)
    baseline = store.read("prefixes_proto_profile_1d", first - (BASELINE_DAYS + 1) * DAY, last)
    if dims.versions:
        history = dims.versions()
        threshold = versions.threshold_log_replay(totals, history, first, last, max_duration)
        ddos = versions.ddos_log_replay(profile, baseline, history, first, last)
    else:
        rules = dims.rules()
        threshold = alerts.threshold_alert_log_grid(totals, rules, first, last, max_duration)
        ddos = alerts.ddos_alert_log_grid(profile, baseline, rules, first, last)
    _log(store, f"from.{first}.{last}", threshold, ddos, outbox)


def _log(store: Store, part: str, threshold: DataFrame, ddos: DataFrame, outbox: str | None) -> None:
    written = [store.write("threshold_alerts", threshold, part), store.write("advanced_ddos_alerts", ddos, part)]
    store.publish(*written)
    if outbox:
        for one in written:
            hand_off(store.read_written(one), f"{outbox}/{one.table}", part)


def start_evaluation(
    spark: SparkSession,
    store: Store,
    dims: Dimensions,
    checkpoint: str,
    every: str = "60 seconds",
    outbox: str | None = None,
    max_duration: int = MAX_DURATION,
    shift: int = 0,
) -> StreamingQuery:
    """Evaluate on a timer: each trigger judges every minute since the one before.

    The minutes come from the ticks' own times, so a repeated trigger judges the
    same ones and replaces its rows, and a pause leaves none out. ``shift``
    (seconds) moves them, to replay old data.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def judge(batch: DataFrame, _: int) -> None:
        seconds = F.unix_seconds("timestamp")
        first, last = batch.agg(F.min(seconds), F.max(seconds)).first()
        if first is not None:
            evaluate_span(store, dims, first + shift, last + shift, outbox, max_duration)

    return (
        ticks.writeStream.foreachBatch(judge)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )


def hand_off(found: DataFrame, path: str, part: str) -> str:
    """Write alerts as JSON lines for another program, in a folder of the evaluation's own.

    Handing over an evaluation again replaces its lines; others stay until collected.
    """
    folder = f"{path}/{part}"
    found.write.mode("overwrite").json(folder)
    return folder
