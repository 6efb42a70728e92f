import json
import os
import time
from collections.abc import Iterator

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weirmark import schema
from weirmark.operators import alerts, enrich, prefix, rollup
from weirmark.plans import fixture as fx
from weirmark.plans import queries as q
from weirmark.sources import flows as sources
from weirmark.sources.tables import Store
from weirmark.streaming import pipeline

SF = "/root/testdata/sf0.001"


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.fixture
def live(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.create()
    dims = pipeline.Dimensions(
        lambda: fx.routers(spark, SF), lambda: fx.rules(spark, SF), lambda: fx.protocols(spark))
    return store, dims, tmp_path


def test_stream_equals_batch_and_replay_changes_nothing(spark, live):
    store, dims, tmp = live
    source = str(tmp / "in")
    flows = fx.flows(spark, SF).cache()
    # the second file brings late flows for minutes of the first
    for part in range(2):
        flows.filter(f"sequence_num % 2 = {part}").coalesce(1).write.mode("append").parquet(source)
    stream = sources.file_flows(spark, source, max_files=1)
    pipeline.start_ingest(stream, store, dims, str(tmp / "cp"), availableNow=True).awaitTermination()
    assert store.read("raw").count() == flows.count()
    tagged = fx.tagged(spark, SF)
    minute, keys = rollup.prefix_totals(tagged).cache(), ["prefix", "time_received"]
    assert same(rollup.merge_partials(store.read("prefixes_total_1m"), keys), minute)
    assert same(rollup.merge_partials(store.read("prefixes_src_profile_10m"), ["prefix", "network", "time_received"]),
                rollup.source_profile(tagged))
    assert same(rollup.merge_partials(store.read("prefixes_proto_profile_1m"), [*keys, "proto"]),
                rollup.class_profile(tagged))
    stream = pipeline.stream_id(spark, str(tmp / "cp"))
    pipeline.ingest_batch(store, dims, flows.filter("sequence_num % 2 = 1"), 1, stream)
    pipeline.ingest_batch(store, dims, flows.limit(0), 2, stream)
    assert same(rollup.merge_partials(store.read("prefixes_total_1m"), keys), minute)
    pipeline.refresh_ranges(store, dims)
    assert store.read("prefixes_range").count() == prefix.prefix_ranges(dims.rules()).count()


def test_new_checkpoint_keeps_old_rows(spark, live):
    store, dims, tmp = live
    flows = fx.flows(spark, SF).limit(40).coalesce(1)
    for name in ("one", "two"):  # two streams, each begins at batch 0
        flows.write.parquet(str(tmp / name))
        stream = sources.file_flows(spark, str(tmp / name), max_files=1)
        pipeline.start_ingest(stream, store, dims, str(tmp / f"cp-{name}"), availableNow=True).awaitTermination()
    assert store.read("raw").count() == 80


def test_changed_rule_counts_from_the_next_batch(spark, live):
    store, dims, _ = live
    flows = fx.flows(spark, SF).filter("etype = 2048").limit(30).cache()
    rules = [dims.rules().limit(1).selectExpr("* EXCEPT (prefixes)", f"array('{p}') AS prefixes").select(*schema.RULES.names)
             for p in ("10.0.0.0/8", "0.0.0.0/0")]
    for batch, now in enumerate(rules):
        dims.rules = lambda now=now: now
        pipeline.ingest_batch(store, dims, flows, batch)
    found = {r.prefix: r.n for r in store.read("prefixes_total_1m").groupBy("prefix").agg(F.sum("flows").alias("n")).collect()}
    assert found == {"10.0.0.0/8": 30, "0.0.0.0/0": 30}


def test_failed_batch_shows_nothing(spark, live, monkeypatch):
    store, dims, _ = live
    flows = fx.flows(spark, SF).limit(30)
    with monkeypatch.context() as m:
        m.setattr(rollup, "class_profile", lambda _: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            pipeline.ingest_batch(store, dims, flows, 0)
    assert all(store.read(name).isEmpty() for name in ("raw", "prefixes_total_1m", "prefixes_src_profile_10m"))
    pipeline.ingest_batch(store, dims, flows, 0)
    assert store.read("raw").count() == 30


def test_evaluation_appends_once_per_moment(spark, live):
    store, dims, tmp = live
    classes = q._classes(spark, SF, fx.NATURAL).cache()
    store.append("prefixes_proto_profile_1m", classes, 0)
    store.append("prefixes_total_1m", rollup.prefix_totals(fx.tagged(spark, SF, fx.NATURAL)), 0)
    now = 1704686340 + 20  # a minute with alerts
    for _ in range(2):
        pipeline.learn_baseline(store, now - 7 * 86400)
        pipeline.evaluate(store, dims, now, str(tmp / "out"))
    found = store.read("advanced_ddos_alerts")
    want = alerts.ddos_alert_log(classes, rollup.daily_baseline(classes), dims.rules(), now)
    assert not want.isEmpty() and same(found.drop("date"), want)
    folder = tmp / "out" / "advanced_ddos_alerts" / f"at.{now}"
    lines = [json.loads(l) for f in os.listdir(folder) if f.endswith(".json") for l in open(folder / f)]
    assert len(lines) == want.count() and lines[0]["rule_name"].startswith("Supplier")
    pipeline.evaluate(store, dims, now + 60, str(tmp / "out"))
    assert len(os.listdir(tmp / "out" / "advanced_ddos_alerts")) == 2  # what was not collected yet stays


def test_timer_judges_every_minute(spark, live):
    store, dims, tmp = live
    store.append("prefixes_total_1m", rollup.prefix_totals(fx.tagged(spark, SF)), 0)
    base = q.BASE + 598 * 60
    pipeline.evaluate_span(store, dims, base, base + 600)
    whole = alerts.threshold_alert_log_grid(store.read("prefixes_total_1m"), dims.rules(), base, base + 600)
    assert not whole.isEmpty() and same(store.read("threshold_alerts").drop("date"), whole)
    shift = base + 60 - int(time.time())
    query = pipeline.start_evaluation(spark, store, dims, str(tmp / "tick"), "1 second", shift=shift)
    try:
        for _ in range(240):
            if query.exception() or any("from." in n for n in os.listdir(store.path("threshold_alerts") + "/finished/date=2024-01-01")
                                        if f"from.{base}.{base + 600}@" not in n):
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert query.exception() is None


def test_daily_upkeep(spark, live):
    store, dims, _ = live
    day = q.BASE // 86400
    for part in range(3):
        store.append("prefixes_proto_profile_1m", q._classes(spark, SF, fx.NATURAL), part)
    for _ in range(2):
        pipeline.daily_upkeep(store, (day + 5) * 86400 + 60)
    merged = store.read("prefixes_proto_profile_1m", (day + 4) * 86400, (day + 5) * 86400 - 1).drop("date")
    assert same(merged, rollup.merge_partials(merged, ["prefix", "time_received", "proto"])) and not merged.isEmpty()
    learnt = store.read("prefixes_proto_profile_1d").drop("date")
    assert same(learnt, rollup.daily_baseline(merged))
    pipeline.daily_upkeep(store, (day + 70) * 86400)
    assert store.read("prefixes_proto_profile_1m").isEmpty()


def test_watermarked_totals(spark, tmp_path):
    fx.flows(spark, SF).coalesce(1).write.parquet(str(tmp_path / "in"))
    index = prefix.index_prefixes(prefix.prefix_ranges(fx.rules(spark, SF)))
    tagged = enrich.tag_flows(sources.file_flows(spark, str(tmp_path / "in")), fx.routers(spark, SF), index)
    query = (pipeline.watermarked_totals(tagged).writeStream.outputMode("update").format("memory")
             .queryName("watermarked").option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert same(spark.table("watermarked"), q.prefix_totals_1m(spark, SF))


def plain_decoder(payload):
    """Stands in for Spark's protobuf module, which the test machine lacks."""

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parse = sources.message_class(sources.descriptor_set()).FromString
        for batch in batches:
            messages = [parse(value) for value in batch]
            # 64-bit numbers in two's complement, as Spark's own decoder gives them
            whole = lambda v: v - (1 << 64) if isinstance(v, int) and v >= 1 << 63 else v
            yield pd.DataFrame({name: [whole(getattr(m, name)) for m in messages] for name in sources.FIELDS})

    return F.pandas_udf(decode, returnType=schema.FLOW)(payload)


def test_kafka_source_needs_its_connector(spark):
    with pytest.raises(Exception, match="kafka"):
        sources.kafka_flows(spark, "localhost:1")


def test_protobuf_frames(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    message = sources.message_class(sources.descriptor_set())
    rows = fx.flows(spark, SF).orderBy("sequence_num").limit(50).collect()
    frames = []
    for i, row in enumerate(rows):
        values = row.asDict()
        body = message(**values).SerializeToString() + (b"\x98\x06\x05" + b"\x98\x06\x05" * i)  # unknown field 99
        size, head = len(body), b""
        while size >= 0x80:
            head, size = head + bytes([size & 0x7F | 0x80]), size >> 7
        frames.append((bytes(head + bytes([size]) + body),))
    records = spark.createDataFrame(frames, "value binary")
    decoded = sources.decode_flows(records, decoder=plain_decoder)
    assert decoded.schema.names == schema.FLOW.names
    got = {r.sequence_num: r for r in decoded.collect()}
    assert got == {r.sequence_num: r for r in rows}
    shown = sources.readable_flows(decoded).orderBy("sequence_num").first()
    assert shown.dst_addr == ".".join(str(b) for b in rows[0].dst_addr[:4]) and shown.time_received.year == 2024
    assert shown.asDict().keys() >= {"src_addr", "next_hop", "time_flow_start"}


def test_large_unsigned_numbers_are_quarantined(spark):
    pytest.importorskip("google.protobuf")
    message = sources.message_class(sources.descriptor_set())
    body = message(bytes=2**64 - 1, packets=1, sampling_rate=1, dst_addr=bytes([10, 0, 0, 1]), etype=0x800)
    records = spark.createDataFrame([(body.SerializeToString(),)], "value binary")
    index = prefix.index_prefixes(prefix.prefix_ranges(fx.rules(spark, SF)))
    flows = sources.decode_flows(records, framed=False, decoder=plain_decoder)
    raw = enrich.enrich_flows(flows, fx.routers(spark, SF), index, fx.protocols(spark))
    assert [r.bytes for r in enrich.out_of_range(raw).collect()] == [-1]
