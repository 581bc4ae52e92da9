"""Written copies of frames in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="gridloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, one of our own in local mode, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/gridloom"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a store has this folder or file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage at a copy that outlives any executor, lets several readers
    see the same rows and prune their columns. The folder is the cluster's to clean;
    tables that nobody reads later belong in a `Scratch`.
    """
    return _written(df, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def small(df: DataFrame, most_bytes: int = 16 << 20, rows: int = 1_000_000) -> DataFrame:
    """A staged table with a broadcast hint, if both its stored bytes and its rows are few; else as it is."""
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if stored <= most_bytes and df.limit(rows + 1).count() <= rows else df


def _written(df: DataFrame, path: str, distinct: tuple[str, ...] = ()) -> DataFrame:
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in distinct}
    df.write.options(compression="zstd", **plain).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables of one operator, deleted together when its result has been written, or one by one before."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self._paths = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", {}

    def staged(self, df: DataFrame, name: str, distinct: tuple[str, ...] = ()) -> DataFrame:
        """``distinct`` names columns that hardly ever repeat a value, for which no dictionaries are tried."""
        path = f"{self.path}/{name}-{len(self._paths)}"
        out = _written(df, path, distinct)
        self._paths[id(out)] = ([path], out)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables of this scratch that no later step reads."""
        for t in tables:
            if t is not None and id(t) in self._paths:
                for path in self._paths[id(t)][0]:
                    delete(self.spark, path)

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """Staged tables of one schema as one table."""
        paths = [path for t in tables for path in self._paths[id(t)][0]]
        out = self.spark.read.schema(tables[0].schema).parquet(*paths)
        self._paths[id(out)] = (paths, out)
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)
