"""Stored tables: facts, rollups, baselines, alert logs.

A table is a folder of parquet files. Each batch, evaluation or learnt day is a part; a
job that runs again replaces its part instead of doubling the rows. Rows
are divided by UTC date and sorted by key, so a reader lists only the days it
wants and skips row groups. Closed days of rollups are merged by a plain batch job.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirmark import schema
from weirmark.functions.timeslot import DAY, time_range, utc_date
from weirmark.operators.retention import KEEP, retain
from weirmark.operators.rollup import merge_partials


@dataclass(frozen=True)
class Table:
    name: str
    layout: T.StructType
    time: str | None  # column the date partitions come from
    order: tuple[str, ...]  # sort key within files
    compression: str = "snappy"


TABLES = {
    t.name: t
    for t in (
        Table("raw", schema.RAW, "time_received", ("time_received",)),
        Table("raw_out_of_range", schema.RAW, "time_received", ("time_received",)),
        Table(
            "prefixes_total_1m", schema.PREFIX_TOTALS, "time_received", ("prefix", "time_received")
        ),
        Table("prefixes_range", schema.PREFIX_RANGES, None, ("start", "end")),
        Table(
            "prefixes_src_profile_10m",
            schema.SOURCE_PROFILE,
            "time_received",
            ("prefix", "network", "time_received"),
            "zstd",
        ),
        Table(
            "prefixes_proto_profile_1m",
            schema.CLASS_PROFILE,
            "time_received",
            ("prefix", "time_received"),
        ),
        Table(
            "prefixes_proto_profile_1d",
            schema.DAILY_BASELINE,
            "time_received",
            ("prefix", "proto", "time_received"),
        ),
        Table("threshold_alerts", schema.THRESHOLD_ALERTS, "alert_time", ("alert_time",)),
        Table("advanced_ddos_alerts", schema.DDOS_ALERTS, "alert_time", ("alert_time",)),
    )
}


# rollups whose closed days are merged, and the key of a merged row
MERGED = {
    "prefixes_total_1m": ["prefix", "time_received"],
    "prefixes_src_profile_10m": ["prefix", "network", "time_received"],
    "prefixes_proto_profile_1m": ["prefix", "time_received", "proto"],
}


@dataclass(frozen=True)
class Written:
    """Rows that were written and may be published."""

    table: str
    part: str
    attempt: str


class Store:
    """The tables under one folder.

    ``<table>/<attempt>/date=<day>`` holds files. A reader follows the names in
    ``<table>/finished/<day>``, one empty file ``<part>@<attempt>`` for each part, and of
    a part takes the latest attempt; so it never sees rows of a failed or unfinished job.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, df: DataFrame, part: str) -> Written:
        """Write the rows of one batch, evaluation or day, not yet visible."""
        table = TABLES[name]
        done = Written(name, part, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")
        df = df.select(*table.layout.names)
        if table.time:
            df = df.withColumn("date", F.expr(utc_date(table.time)))
        order = ("date", *table.order) if table.time else table.order
        writer = df.sortWithinPartitions(*order).write.option("compression", table.compression)
        if table.compression == "zstd":
            writer = writer.option("parquet.compression.codec.zstd.level", "6")
        if table.time:
            writer = writer.partitionBy("date")
        writer.parquet(self._folder(done))
        return done

    def _folder(self, written: Written) -> str:
        return f"{self.path(written.table)}/{written.attempt}"

    def publish(self, *written: Written) -> None:
        """Make rows visible, and those of earlier attempts at the same parts invisible."""
        for one in written:
            days = self._list(self._folder(one), "date=*") if TABLES[one.table].time else ["all"]
            for day in {*days, *self._days_of(one.table, one.part)}:
                marker = self._hadoop(f"{self.path(one.table)}/finished/{day}/{one.part}@{one.attempt}")
                self._files(marker).create(marker, True).close()

    def append(self, name: str, df: DataFrame, part: str | int) -> None:
        """Write and publish; a part that is there already is replaced."""
        self.publish(self.write(name, df, str(part)))

    def replace(self, name: str, df: DataFrame) -> None:
        """Replace a whole small table."""
        self.append(name, df, "whole")

    def _list(self, folder: str, pattern: str) -> list[str]:
        path = self._hadoop(f"{folder}/{pattern}")
        return [s.getPath().getName() for s in self._files(path).globStatus(path) or []]

    def _days_of(self, name: str, part: str) -> set[str]:
        """Days in which an earlier attempt at the part has rows."""
        path = self._hadoop(f"{self.path(name)}/finished/*/{part}@*")
        return {s.getPath().getParent().getName() for s in self._files(path).globStatus(path) or []}

    def _parts(self, name: str, day: str) -> dict[str, str]:
        """The latest attempt at each part, without what a merged part stands for."""
        latest: dict[str, str] = {}
        for marker in sorted(self._list(f"{self.path(name)}/finished/{day}", "*@*")):
            part, attempt = marker.rsplit("@", 1)
            latest[part] = max(attempt, latest.get(part, ""))
        if "merged" in latest:
            listed = self.spark.read.text(f"{self.path(name)}/{latest['merged']}/merged-{day}.txt").collect()
            for line in listed:
                part, attempt = line[0].rsplit("@", 1)
                if part != "merged" and latest.get(part) == attempt:
                    del latest[part]
        return latest

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        table = TABLES[name]
        layout = T.StructType(list(table.layout.fields))
        if table.time:
            layout = layout.add("date", T.DateType())
        parts = [
            self.spark.read.schema(table.layout).parquet(*some).withColumn("date", F.lit(day).cast("date"))
            if table.time
            else self.spark.read.schema(table.layout).parquet(*some)
            for day, some in _by_day(folders)
        ]
        found = parts[0] if parts else self.spark.createDataFrame([], layout)
        for more in parts[1:]:
            found = found.unionByName(more)
        return found.select(*layout.names)

    def read(self, name: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """Rows from ``start`` to ``end`` (seconds, inclusive), with their ``date``.

        Only the days asked for are listed.
        """
        table = TABLES[name]
        days = self._list(f"{self.path(name)}/finished", "*")
        if table.time:
            inside = [
                day
                for day in days
                if (start is None or _day(day) >= start // DAY) and (end is None or _day(day) <= end // DAY)
            ]
        else:
            inside = days
        folders = []
        for day in sorted(inside):
            for attempt in sorted(self._parts(name, day).values()):
                folder = f"{self.path(name)}/{attempt}" + (f"/{day}" if table.time else "")
                if self._exists(folder):
                    folders.append(folder)
        found = self._read(name, folders)
        return found if start is None and end is None else time_range(found, start, end, table.time)

    def live(self, name: str, now: int) -> DataFrame:
        """Rows that have not expired: exact for alerts, by day for the rest."""
        keep = KEEP[name]
        found = self.read(name, now - keep - DAY)
        return retain(found, TABLES[name].time, keep, now, by_day=keep >= DAY)

    def read_written(self, written: Written) -> DataFrame:
        """Rows that were written, published or not."""
        folder = self._folder(written)
        days = self._list(folder, "date=*") if TABLES[written.table].time else []
        return self._read(written.table, [f"{folder}/{day}" for day in sorted(days)])

    def merge_day(self, name: str, day: int) -> None:
        """Add up the partials of a closed day (number of days since 1970) and write them as one part.

        The merged part lists the attempts it stands for; rows that come later are read beside it
        until the day is merged again.
        """
        label = f"date={date.fromordinal(date(1970, 1, 1).toordinal() + day).isoformat()}"
        parts = self._parts(name, label)
        if not parts or list(parts) == ["merged"]:
            return
        rows = self.read(name, day * DAY, day * DAY + DAY - 1)
        done = self.write(name, merge_partials(rows, MERGED[name]), "merged")
        earlier = self._parts_listed(name, label, parts)
        lines = self.spark.createDataFrame([(x,) for x in earlier], "value string")
        lines.coalesce(1).write.text(f"{self._folder(done)}/merged-{label}.txt")
        self.publish(done)

    def _parts_listed(self, name: str, label: str, parts: dict[str, str]) -> list[str]:
        """The parts read now, and those that the last merged part stood for."""
        lines = [f"{part}@{attempt}" for part, attempt in parts.items()]
        if "merged" in parts:
            old = self.spark.read.text(f"{self.path(name)}/{parts['merged']}/merged-{label}.txt").collect()
            lines += [r[0] for r in old]
        return lines

    def create(self) -> None:
        """Create the folders of all tables, so that they can be listed."""
        for name in TABLES:
            path = self._hadoop(f"{self.path(name)}/finished")
            self._files(path).mkdirs(path)

    def _exists(self, path: str) -> bool:
        place = self._hadoop(path)
        return self._files(place).exists(place)

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop_expired(self, name: str, now: int) -> list[str]:
        """Delete the days all of whose rows have expired."""
        last = (now - KEEP[name]) // DAY
        if KEEP[name] < DAY:
            last -= 1  # rows expire one by one here, the day must be over
        dropped = []
        for day in self._list(f"{self.path(name)}/finished", "date=*"):
            if _day(day) > last:
                continue
            for marker in self._list(f"{self.path(name)}/finished/{day}", "*@*"):
                self._delete(f"{self.path(name)}/{marker.rsplit('@', 1)[1]}/{day}")
            self._delete(f"{self.path(name)}/finished/{day}")
            dropped.append(day)
        return sorted(dropped)

    def _delete(self, path: str) -> None:
        place = self._hadoop(path)
        self._files(place).delete(place, True)


def _day(label: str) -> int:
    """Days since 1970 of a folder ``date=...``."""
    return date.fromisoformat(label.split("=")[1]).toordinal() - date(1970, 1, 1).toordinal()


def _by_day(folders: list[str]) -> list[tuple[str, list[str]]]:
    """Folders by their day; all in one if they have none."""
    found: dict[str, list[str]] = {}
    for folder in folders:
        label = folder.rsplit("/", 1)[1]
        found.setdefault(label.split("=")[1] if label.startswith("date=") else "", []).append(folder)
    return sorted(found.items())
