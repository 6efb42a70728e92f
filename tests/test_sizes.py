"""Steps whose cost must not grow with repeated rows, parts or a single input split."""

from datetime import datetime

import pytest

from weirmark.operators import enrich, joins
from weirmark.plans import fixture as fx
from weirmark.plans import queries as q
from weirmark.sources.tables import Store


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events, customers and suppliers of a few rows."""
    root = tmp_path_factory.mktemp("tables")
    kinds = ("click", "view", "error", "purchase", "signup")
    events = [(n, datetime(2024, 1, 1 + n % 3, n % 24), n % 11, kinds[n % 5], n / 4, '{"k": %d}' % (n % 9)) for n in range(60)]
    tables = {
        "events": (events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
        "customer": ([(n, f"c{n}", n % 5) for n in range(12)], "c_custkey long, c_name string, c_nationkey int"),
        "supplier": ([(n, f"s{n}", n % 5) for n in range(30)], "s_suppkey long, s_name string, s_nationkey int"),
    }
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_routers_of_one_address_are_one_row_of_the_lookup(spark, folder, monkeypatch):
    flows = fx.flows(spark, folder)
    routers = spark.range(50).selectExpr(
        "CAST(id AS STRING) AS id", "'n' AS name", "concat('192.168.0.', id % 5) AS router_ip", "id AS default_sampling"
    )
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    few = enrich.scale_samples(flows, routers)
    assert "_salt" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 4)
    dealt = enrich.scale_samples(flows, routers)
    assert "_salt" in dealt._jdf.queryExecution().optimizedPlan().toString()
    assert dealt.rdd.getNumPartitions() == enrich.TASKS_A_SPLIT * flows.rdd.getNumPartitions()
    columns = ["sequence_num", "total_bytes", "total_packets"]
    assert sorted(few.select(columns).collect()) == sorted(dealt.select(columns).collect())
    assert few.filter("sampling_rate = 0 AND total_packets > 0").count() > 0


def test_parts_of_totals_read_flows_that_are_tagged_already(spark, folder, monkeypatch):
    read = []
    append = Store.append
    monkeypatch.setattr(Store, "append", lambda self, name, df, part: (read.append(df.inputFiles()), append(self, name, df, part)))
    totals = q.stored_totals_merged(spark, folder)
    assert len(read) == 8 and not any("events" in file for files in read for file in files)
    assert totals.exceptAll(q.prefix_totals_1m(spark, folder)).isEmpty()


def test_blocks_are_made_in_many_tasks(spark, folder, monkeypatch):
    before = q._many_prefixes(spark, folder).collect()
    monkeypatch.setattr(q, "ROWS_A_TASK", 4)
    blocks = q._many_prefixes(spark, folder)
    assert blocks.rdd.getNumPartitions() == 2 * 8
    assert sorted(blocks.collect()) == sorted(before)


def test_lots_of_a_stream_may_have_many_files(spark, folder, monkeypatch):
    monkeypatch.setattr(q, "FLOWS_A_FILE", 6)
    files = []
    taken = q.sources.file_flows
    monkeypatch.setattr(q.sources, "file_flows", lambda *a, **k: (files.append(k["max_files"]), taken(*a, **k))[1])
    streamed = q.stream_equals_batch(spark, folder)
    whole = q.prefix_totals_1m(spark, folder).select(streamed.columns)
    assert files == [3] and streamed.exceptAll(whole).isEmpty() and whole.exceptAll(streamed).isEmpty()
