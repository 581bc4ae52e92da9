"""Sinks: CSV export, job reports, idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridloom.operators.schedule import append_new


def watch_list_csv(df: DataFrame, path: str) -> None:
    """Semicolons, every field quoted, nulls empty, UTF-8.

    The part files in order are one CSV file: the first has the byte-order mark and the
    header, and nothing else.
    """
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(";", *[quoted(F.coalesce(df[c].cast("string"), F.lit(""))) for c in df.columns])
    header = F.concat(F.lit("\ufeff"), F.concat_ws(";", *[quoted(F.lit(c)) for c in df.columns]))
    df.sparkSession.range(1, numPartitions=1).select(header.alias("line")).union(df.select(line)).write.text(path)


def report(rows: DataFrame, path: str, summary: DataFrame) -> None:
    """A job's rows and its one-row summary as tables."""
    rows.write.parquet(f"{path}/rows")
    summary.write.parquet(f"{path}/summary")


def append(table: str, new: DataFrame, key: list[str]) -> int:
    """Append rows with new keys to a Parquet folder; returns how many. A replay appends none."""
    spark = new.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        fresh = new.dropDuplicates(key)
    else:
        fresh = append_new(spark.read.parquet(table), new, key)
    appended = Observation()
    fresh.observe(appended, F.count("*").alias("n")).write.mode("append").parquet(table)
    return appended.get.get("n", 0)
