"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


#: Rows that go to a Python worker at once; texts are long, so a task's memory stays small.
ARROW_ROWS = 2000


def short_batches(spark) -> None:
    """Bound the rows of an Arrow batch of this session, unless the user has set a smaller bound."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def map_arrow(frame: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` in short batches."""
    short_batches(frame.sparkSession)
    return frame.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def id_crc(value: object) -> int:
    """crc32 of an id written as text; of the empty text where it is null."""
    return zlib.crc32(b"" if value is None else str(value).encode())


def crc_of(column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def free_name(frame: DataFrame, wanted: str) -> str:
    """``wanted``, or that with underscores if the frame already has such a column."""
    taken = {c.lower() for c in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


class Cached:
    """Results by key, computed for many keys at once and kept in two generations of bounded size.

    ``compute`` maps a list of keys to a list of results. A key that was used since
    the last change of generation survives the next one.
    """

    def __init__(self, compute: Callable[[list[str]], list], limit: int = 300_000, fixed: dict | None = None):
        self.compute, self.limit, self.fixed = compute, limit, fixed or {}
        self.young: dict = dict(self.fixed)
        self.old: dict = {}

    def ready(self, groups: list[list[str]]) -> dict:
        """A table that holds every key of ``groups``."""
        missing: set[str] = set()
        for keys in groups:
            missing |= set(keys).difference(self.young)
        if not missing:
            return self.young
        if len(self.young) + len(missing) > self.limit + len(self.fixed):
            self.old, self.young = self.young, dict(self.fixed)
            missing = set().union(*groups).difference(self.young)
        old = self.old
        fresh = []
        for key in missing:
            if key in old:
                self.young[key] = old[key]
            else:
                fresh.append(key)
        if fresh:
            self.young.update(zip(fresh, self.compute(fresh)))
        return self.young


class Memo(dict):
    """A table that computes what it lacks, kept in two generations of bounded size."""

    def __init__(self, compute: Callable[[str], object], limit: int = 250_000, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.compute, self.fixed, self.old = compute, fixed or {}, {}
        self.limit = limit + len(self.fixed)

    def __missing__(self, key: str):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
            self.update(self.fixed)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value
