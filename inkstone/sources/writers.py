"""CSV export, snapshots and guarded loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkstone.operators.common import first_per_key
from inkstone.operators.log import EXPORT_COLUMNS, csv_lines
from inkstone.session import path_exists


def write_csv_export(entries: DataFrame, path: str) -> None:
    """Fully quoted export, newest first within and across files.

    Files are range-partitioned on the time, so no task holds the whole export.
    """
    cells = [F.array_join("tags", " ").alias("tags") if c == "tags" else F.col(c) for c in EXPORT_COLUMNS]
    out = entries.orderBy(F.col("created_at").desc(), F.col("id")).select(*cells)
    out = out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in EXPORT_COLUMNS])
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Full dump of every column."""
    df.write.mode("overwrite").format(fmt).save(path)


def restore_rows(current: DataFrame, dump: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a dump the table lacks; one per id, so restoring twice adds nothing."""
    rest = [F.col(c) for c in dump.columns if c != key]
    order = [F.col("created_at")] if "created_at" in dump.columns else [F.xxhash64(*rest)]
    return first_per_key(dump, [key], order).select(*dump.columns).join(current.select(key), key, "left_anti").select(*dump.columns)


def restore_snapshot(current: DataFrame, dump: DataFrame, path: str, key: str = "id") -> None:
    restore_rows(current, dump, key).write.mode("append").parquet(path)


def seed_table(words: DataFrame, path: str) -> bool:
    """Load the lexicon only if the table holds less than half of it; all or nothing."""
    spark = words.sparkSession
    have = spark.read.parquet(path).count() if path_exists(spark, path) else 0
    if have >= words.count() / 2:
        return False
    words.write.mode("overwrite").parquet(path)
    return True


def append_asks(history: DataFrame, path: str) -> None:
    """Append prepared history rows, one folder per day."""
    history.write.mode("append").partitionBy("day").parquet(path)


__all__ = ["append_asks", "csv_lines", "restore_rows", "restore_snapshot", "seed_table", "write_csv_export", "write_snapshot"]
