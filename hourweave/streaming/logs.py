"""Append-only logs of keyed rows, in one folder per batch and day.

A batch owns one segment, ``segment=<2 x batch>/day=<day>``, which a retry overwrites; the marker file of
the finished write tells whole segments from torn ones. A merge of all batches up to b is the segment 2 b + 1. A read lists the
folders' names, opens only the days asked for, and of each day only the newest merged segment and those after it.
Rows of an equal key come down to that of the latest segment, so a merge changes no result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourweave.operators.clean import last_by

_DATELESS = "all"
_NAMES = re.compile(r"segment=(-?\d+)/day=([^/]+)$")


def latest(log: DataFrame, key: tuple) -> DataFrame:
    """The row of the highest ``seq`` per key."""
    values = [c for c in log.columns if c not in (*key, "seq")]
    return last_by(log, list(key), ["seq"], values)


class DayLog:
    """One log; ``dated`` ones are cut by the day of ``timestamp``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: tuple, dated: bool = True):
        self.spark, self.path, self.schema, self.key, self.dated = spark, path, schema, key, dated
        self._full = T.StructType(
            [*schema.fields, T.StructField("segment", T.LongType()), T.StructField("day", T.StringType())]
        )

    def _matching(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return [str(f.getPath().toString()) for f in found or []]

    def segments(self) -> dict[str, list[int]]:
        """Finished segments of each day, in order."""
        whole = {re.search(r"segment=(-?\d+)/", f)[1] for f in self._matching("segment=*/_SUCCESS")}
        days: dict[str, list[int]] = {}
        for name in self._matching("segment=*/day=*"):
            number, day = _NAMES.search(name).groups()
            if number in whole:
                days.setdefault(day, []).append(int(number))
        return {day: sorted(numbers) for day, numbers in days.items()}

    def _live(self, upto: int | None, first_day: str | None) -> dict[str, list[int]]:
        """Of each day the newest merged segment up to batch ``upto`` and all later ones."""
        live = {}
        for day, numbers in self.segments().items():
            if self.dated and first_day is not None and day < first_day:
                continue
            known = [n for n in numbers if upto is None or n <= 2 * upto + 1]
            merged = max((n for n in known if n % 2), default=None)
            live[day] = [n for n in known if merged is None or n >= merged]
        return {day: numbers for day, numbers in live.items() if numbers}

    def _open(self, folders: list[tuple[int, str]]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self._full)
        paths = [f"{self.path}/segment={n}/day={day}" for n, day in folders]
        return self.spark.read.schema(self._full).option("basePath", self.path).parquet(*paths)

    def read(self, upto: int | None = None, first_day: str | None = None) -> DataFrame:
        """Current rows as of batch ``upto``, from ``first_day`` (``yyyy-MM-dd``) on."""
        folders = [(n, day) for day, numbers in self._live(upto, first_day).items() for n in numbers]
        rows = self._open(sorted(folders)).withColumnRenamed("segment", "seq").drop("day")
        return latest(rows, self.key).select(*self.schema.names)

    def _write(self, rows: DataFrame, segment: int) -> None:
        day = F.date_format("timestamp", "yyyy-MM-dd") if self.dated else F.lit(_DATELESS)
        out = rows.select(*self.schema.names).withColumn("day", day)
        # few files per day, and a day with very many rows is split by size
        out.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/segment={segment}")

    def write(self, rows: DataFrame, batch: int) -> DataFrame:
        """Write a batch's rows (over those of an earlier try) and read them back."""
        self._write(rows, 2 * batch)
        mine = [(2 * batch, day) for day, numbers in self.segments().items() if 2 * batch in numbers]
        return self._open(mine).select(*self.schema.names)

    def compact(self, upto: int, most: int, first_day: str | None = None) -> int:
        """Merge the days from ``first_day`` on that have more than ``most`` live segments; returns how many.

        What a merge replaces stays for readers that have begun, and is deleted with the next merge of that day.
        """
        busy = {day: numbers for day, numbers in self._live(upto, first_day).items() if len(numbers) > most}
        if not busy:
            return 0
        rows = self._open(sorted((n, day) for day, numbers in busy.items() for n in numbers))
        merged = latest(rows.withColumnRenamed("segment", "seq").drop("day"), self.key)
        self._write(merged, 2 * upto + 1)
        for day, numbers in self.segments().items():
            if day in busy:
                for n in numbers:
                    if n < busy[day][0]:
                        self._delete(f"{self.path}/segment={n}/day={day}")
        return len(busy)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
