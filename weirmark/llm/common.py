"""Small helpers of the text operators."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the query contracts spell it (Java and RE2 read it alike).
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session is a single process (tests) a
    temporary folder is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weirmark-llm-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def per_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """``make()``, once in each Python worker: later tasks of the process find it again.

    Functions travel by value, so their module's globals do not outlive a task.
    """
    kept = sys.modules.setdefault("weirmark_worker", types.ModuleType("weirmark_worker"))
    store = kept.__dict__.setdefault("store", {})
    if key not in store:
        store.clear()  # one large object at a time
        store[key] = make()
    return store[key]


class ByteCache:
    """Entries used lately, of ``limit`` bytes or so; their sizes are told by who adds them.

    Entries live in two halves. When the younger is full it becomes the older one, and what
    was the older goes; an entry that is asked for is taken along into the younger half, where it
    counts with the average size of the older one's.
    """

    def __init__(self, limit: int):
        self.half = limit // 2
        self.young: dict = {}
        self.old: dict = {}
        self.size = self.mean = 0.0

    def add(self, entries: dict, size: int) -> None:
        """``entries`` of ``size`` bytes together; more than fit in a half are not kept."""
        if size > self.half:
            return
        if self.size + size > self.half:
            self.mean = self.size / max(1, len(self.young))
            self.old, self.young, self.size = self.young, {}, 0.0
        self.young.update(entries)
        self.size += size

    def find(self, keys: set) -> tuple[dict, list]:
        """The values of those ``keys`` that are known, and the other keys."""
        here = keys & self.young.keys()
        found = dict(zip(here, map(self.young.__getitem__, here)))
        rest = keys - here
        back = rest & self.old.keys()
        again = dict(zip(back, map(self.old.__getitem__, back)))
        self.young.update(again)
        self.size += len(again) * self.mean
        return found | again, list(rest - back)


def heaviest(counts: DataFrame, weight: str, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the largest ``weight`` (whole, positive), ``limit`` at most, and the other rows (None: there are none).

    The border is a power of two, found from a histogram of 64 rows; no row is sorted or collected.
    """
    power = F.floor(F.log2(F.col(weight).cast("double"))).cast("int")
    bars = counts.groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()
    taken, border = 0, None
    for row in sorted(bars, key=lambda r: -r["power"]):
        if taken + row["n"] > limit:
            break
        taken, border = taken + row["n"], row["power"]
    if border is None:
        return counts.where("false"), counts if bars else None
    rest = counts.where(power < border) if taken < sum(r["n"] for r in bars) else None
    return counts.where(power >= border), rest


def slices_of(sizes: list[int], part: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``part`` bytes each; a row of more is a range of its own."""
    begin, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > part:
            yield begin, at
            begin, held = at, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)
