"""Tables that streams write, each batch once: reconciled imports (T05) and keyed upserts.

A batch that is replayed after a crash writes the same folders again. What it wrote counts
once its commit, the last thing written, is there; readers see committed batches only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.keys import match_key
from gridloom.staging import Scratch, delete, exists

#: What becomes of the observations of an import.
OUTCOMES = ("added", "duplicate", "excluded", "conflict")
OBSERVATION = ["date", "start", "channel", "title", "source_url"]
_SLOT = ["date", "_channel", "start"]


def keyed(rows: DataFrame) -> DataFrame:
    """``_channel`` and ``_title``, by which slots and titles are the same."""
    return rows.withColumn("_channel", match_key(F.col("channel"))).withColumn("_title", match_key(F.col("title")))


def reconcile(observations: DataFrame, saved: DataFrame, first: Column, days: int = 7) -> DataFrame:
    """Every observation of an import with its ``outcome``: added, duplicate, excluded (with a ``reason``) or conflict (with the ``saved_titles`` of its slot).

    ``observations`` has `OBSERVATION`, the ``status`` of the capture that it is from and
    ``pos``, the order of the import. One whose captures of that page, channel and event
    are all stale is excluded (J24), then one outside the ``days`` from ``first``. Of the
    others the first of a free slot is added; the same event again is a duplicate;
    another title in a slot that is taken is held as a conflict (J27) and takes nothing.
    ``saved`` has what earlier imports added. A null title or channel counts as empty.
    """
    obs = keyed(observations.na.fill("", ["title", "channel"]))
    event = [*_SLOT, "_title"]
    captured = obs.groupBy("source_url", "channel", *event).agg(F.bool_and(F.col("status") == "stale").alias("_stale"))
    same = [obs[c].eqNullSafe(captured[c]) for c in ("source_url", "channel", *event)]
    obs = obs.join(captured, same).select(obs["*"], captured["_stale"])
    within = F.col("date").between(first, F.date_add(first, days - 1))
    reason = F.when(F.col("_stale"), "stale_source_after_failed_refresh").when(~F.coalesce(within, F.lit(False)), "outside_the_week")
    obs = obs.withColumn("reason", reason)
    have = keyed(saved).groupBy(*_SLOT).agg(F.array_sort(F.collect_set("title")).alias("_saved"), F.collect_set("_title").alias("_known"))
    opening = obs.where("reason IS NULL").groupBy(*_SLOT).agg(F.min(F.struct("pos", "_title", "title")).alias("_first"))
    joined = obs.join(have, _SLOT, "left").join(opening, _SLOT, "left")
    known = F.coalesce(F.array_contains("_known", F.col("_title")), F.col("_first._title") == F.col("_title"))
    outcome = F.when(F.col("reason").isNotNull(), "excluded").when(F.col("_saved").isNull() & (F.col("pos") == F.col("_first.pos")), "added").when(known, "duplicate").otherwise("conflict")
    out = joined.withColumn("outcome", outcome)
    titles = F.when(F.col("outcome") == "conflict", F.coalesce("_saved", F.array("_first.title")))
    return out.withColumn("saved_titles", titles).select(*OBSERVATION, "outcome", "reason", "saved_titles")


def committed(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The rows of the table ``name`` under ``root`` whose batch is in the ledger, with ``batch``; none before the first batch."""
    if not exists(spark, f"{root}/ledger"):
        return spark.createDataFrame([], f"{schema}, batch bigint")
    ledger = spark.read.schema("rows bigint, batch bigint").parquet(f"{root}/ledger").select("batch").distinct()
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{root}/{name}").join(ledger, "batch", "left_semi")


IMPORTED = "start string, channel string, title string, source_url string, reason string, saved_titles array<string>, date date"


def import_batch(batch: DataFrame, batch_id: int, root: str, first: Column, days: int = 7) -> None:
    """Reconcile one batch into the four tables of ``root``; again, or after a crash at any point, with the same result."""
    spark = batch.sparkSession
    if exists(spark, f"{root}/ledger/batch={batch_id}/_SUCCESS"):
        return
    # only days of the window can hold slots that matter
    saved = committed(spark, root, "added", IMPORTED).where((F.col("batch") < batch_id) & F.col("date").between(first, F.date_add(first, days - 1)))
    with Scratch(spark, "import") as tmp:
        rows = tmp.staged(reconcile(batch, saved, first, days), "reconciled")
        for name in OUTCOMES:
            rows.where(F.col("outcome") == name).drop("outcome").write.mode("overwrite").partitionBy("date").parquet(f"{root}/{name}/batch={batch_id}")
        rows.agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{root}/ledger/batch={batch_id}")


def ingest(captures: DataFrame, root: str, checkpoint: str, rows_of: Callable[[DataFrame], DataFrame], first: Column, days: int = 7):
    """Captures as a stream, each batch of which is an import. ``rows_of`` turns captures into observations."""

    def write(batch: DataFrame, batch_id: int) -> None:
        import_batch(rows_of(batch), batch_id, root, first, days)

    return captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _pointer(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """Which version of each bucket holds, as of the last commit (before a batch)."""
    if not exists(spark, f"{root}/pointer"):
        return None
    jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer")
    done = [int(s.getPath().getName().partition("=")[2]) for s in jvm.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jvm) if s.isDirectory()]
    done = [v for v in done if (before is None or v < before) and exists(spark, f"{root}/pointer/version={v}/_SUCCESS")]
    return spark.read.schema("bucket int, at_version bigint").parquet(f"{root}/pointer/version={max(done)}") if done else None


def _version_rows(spark: SparkSession, root: str, pointer: DataFrame, schema: str) -> DataFrame:
    rows = spark.read.schema(f"{schema}, version bigint, bucket int").parquet(f"{root}/rows")
    held = F.broadcast(pointer.withColumnRenamed("bucket", "_bucket"))  # a row a bucket at most, whose number is a parameter
    return rows.join(held, (F.col("bucket") == F.col("_bucket")) & (F.col("version") == F.col("at_version"))).drop("version", "at_version", "_bucket")


def upsert_batch(batch: DataFrame, batch_id: int, root: str, key: list[str], order: list[str], buckets: int = 64) -> None:
    """Rows of a batch replace those of their key in the table of ``root``, unless theirs is greater by ``order``.

    The buckets that hold keys of the batch are written anew under its number; then the
    pointer, a row a bucket, names the version that holds, in one commit. Buckets without
    such keys are neither read nor written. A batch replayed before its commit starts from
    the pointer before it and writes the same files; one that is committed is passed over.
    """
    spark = batch.sparkSession
    if exists(spark, f"{root}/pointer/version={batch_id}/_SUCCESS"):
        return
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
    with Scratch(spark, "upsert") as tmp:
        new = tmp.staged(batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")), "batch")
        touched = new.select("bucket").distinct()
        pointer = _pointer(spark, root, before=batch_id)
        both = new
        if pointer is not None:
            both = new.unionByName(_version_rows(spark, root, pointer.join(F.broadcast(touched), "bucket", "left_semi"), schema))
        rest = [c for c in batch.columns if c not in key]
        latest = both.groupBy("bucket", *key).agg(F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest))).alias("_r")).select("bucket", *key, *[F.col(f"_r.{c}") for c in rest])
        latest.select(*batch.columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/rows/version={batch_id}")
        now = touched.withColumn("at_version", F.lit(batch_id).cast("long"))
        if pointer is not None:
            now = now.unionByName(pointer.join(touched, "bucket", "left_anti"))
        now.coalesce(1).write.mode("overwrite").parquet(f"{root}/pointer/version={batch_id}")


def upserted(spark: SparkSession, root: str, schema: str, before: int | None = None) -> DataFrame:
    """The table that `upsert_batch` keeps, as of its last commit (before a batch)."""
    pointer = _pointer(spark, root, before)
    return spark.createDataFrame([], schema) if pointer is None else _version_rows(spark, root, pointer, schema).drop("bucket")


def forget_versions(spark: SparkSession, root: str) -> None:
    """Delete what the last commit no longer names: older pointers, and versions without a bucket of it. Readers that began before it need them."""
    pointer = _pointer(spark, root)
    if pointer is None:
        return
    held = {r["at_version"] for r in pointer.select("at_version").distinct().collect()}  # as many as buckets at most
    last = max(held)
    for folder, keep in (("pointer", {last}), ("rows", held)):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
        for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            version = s.getPath().getName().partition("=")[2]
            if version and int(version) < last and int(version) not in keep:
                delete(spark, f"{root}/{folder}/version={version}")


def upsert(rows: DataFrame, root: str, checkpoint: str, key: list[str], order: list[str], buckets: int = 64):
    """A stream of rows as a table of the latest row of each key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(batch, batch_id, root, key, order, buckets)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
