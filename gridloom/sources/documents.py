"""Readers that flatten nested documents into rows (S01 to S08), and their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORK_SCHEMA = """id string, title string, aliases array<string>, legacy_ids array<string>, year string, director string, creator string, country string,
genre string, duration string, image string, image_remote string, image_fallbacks array<string>, image_source_url string, image_checked date, ratings map<string,string>,
ratings_checked date, ratings_unavailable_reason string, links map<string,string>, kind string, rarity string, history string,
occurrences array<struct<week:string,url:string>>, _rejected string"""
CANDIDATE = "struct<title:string,work_id:string,rank:int,time:string,channel:string,quality:string,summary:string,why:string,image:string>"
ISSUE_SCHEMA = f"""week string, `from` date, `to` date, theme string, publication_status string, pages array<struct<id:string,className:string,html:string>>,
personalization struct<pools:map<string,struct<page_id:string,card_type:string,target:int,desired_reserve:int,shortage_reason:string,candidates:array<{CANDIDATE}>>>>"""
_POOL = f"struct<target:int,candidates:array<{CANDIDATE}>>"
RADAR_SCHEMA = f"week string, popular_scan {_POOL}, popular_deep {_POOL}, hd1 {_POOL}, hd2 {_POOL}"
INVENTORY_SCHEMA = """week string, days array<struct<date:date,channels_scanned:array<string>,channel_counts:map<string,int>,
items:array<struct<title:string,start:string,channel:string,source:string,source_url:string,source_ref:string,pdf_page:int,bbox:array<double>,grid_date:date>>>>"""


def works(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue, by a fixed schema; text that doesn't fit is in ``_rejected``."""
    return spark.read.schema(WORK_SCHEMA).option("columnNameOfCorruptRecord", "_rejected").option("mode", "PERMISSIVE").json(path)


def quarantine_works(spark: SparkSession, path: str, to: str) -> dict[str, int]:
    """A catalogue of JSON lines split in one pass into ``works`` and ``rejected`` under ``to``; how many of each.

    A line is rejected that is no work of the schema, or has no id. ``rejected`` keeps it
    with its ``file``, the ``block`` of the file (the byte at which the split begins) and
    its ``line`` in the block, from 0. Blank lines are neither.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    work = F.from_json("value", WORK_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_rejected"})
    parsed = lines.withColumn("work", work).withColumn("rejected", F.col("work").isNull() | F.col("work._rejected").isNotNull() | F.col("work.id").isNull())
    blank = F.trim("value") == ""
    counted = Observation()
    # blank lines count as places only; the first place of a block tells its lines from those of the block before
    seen = parsed.observe(counted, F.count_if(~blank & ~F.col("rejected")).alias("works"), F.count_if(~blank & F.col("rejected")).alias("rejected"))
    kind = F.when(blank, "blank").when(F.col("rejected"), "rejected").otherwise("works")
    seen.select(kind.alias("kind"), "file", "block", "place", F.when(kind == "rejected", F.col("value")).alias("text"), F.when(kind == "works", F.col("work")).alias("work")).write.partitionBy("kind").parquet(f"{to}/lines")
    return {k: counted.get.get(k) or 0 for k in ("works", "rejected")}


def kept_works(spark: SparkSession, to: str) -> DataFrame:
    """The works that `quarantine_works` kept."""
    return _lines(spark, to).where("kind = 'works'").select("work.*").drop("_rejected")


def rejected_works(spark: SparkSession, to: str) -> DataFrame:
    """The lines that `quarantine_works` rejected: ``file, block, line, text``."""
    lines = _lines(spark, to)
    first = lines.groupBy("file", "block").agg(F.min("place").alias("first"))
    bad = lines.where("kind = 'rejected'").join(first, ["file", "block"])
    return bad.select("file", "block", (F.col("place") - F.col("first")).alias("line"), "text")


def _lines(spark: SparkSession, to: str) -> DataFrame:
    work = StructType.fromDDL(WORK_SCHEMA).simpleString()
    return spark.read.schema(f"file string, block long, place long, text string, work {work}, kind string").parquet(f"{to}/lines")


def issues(spark: SparkSession, path: str, manifest: DataFrame, lookback: int | None = None) -> DataFrame:
    """Published issues of a folder partitioned by week, the newest ``lookback`` of them. The manifest has a row a week, and prunes the partitions."""
    chosen = manifest.where("status <> 'draft'").select("week")
    if lookback is not None:
        chosen = chosen.orderBy(F.desc("week")).limit(lookback)
    return spark.read.schema(ISSUE_SCHEMA).json(path).join(F.broadcast(chosen), "week", "left_semi")


def inventory_rows(inventory: DataFrame) -> DataFrame:
    """``days[].items[]`` as rows with their day and position."""
    day = inventory.select("week", F.explode("days").alias("d"))
    return day.select("week", F.col("d.date").alias("date"), F.posexplode("d.items").alias("pos", "i")).select("week", "date", "pos", "i.*")


def pool_rows(issue: DataFrame) -> DataFrame:
    """Candidates of every pool with the pool's own fields."""
    pool = issue.select("week", F.explode(F.map_entries("personalization.pools")).alias("e"))
    row = pool.select("week", F.col("e.key").alias("pool_id"), F.col("e.value.page_id").alias("page_id"), F.col("e.value.target").alias("target"), F.posexplode("e.value.candidates").alias("pos", "c"))
    return row.select("week", "pool_id", "page_id", "target", "pos", "c.*")


def radar_rows(radar: DataFrame) -> DataFrame:
    """Candidates of the four named pools."""
    named = radar.selectExpr("week", "stack(4, 'popular_scan', popular_scan, 'popular_deep', popular_deep, 'hd1', hd1, 'hd2', hd2) AS (pool_id, p)")
    return named.select("week", "pool_id", F.col("p.target").alias("target"), F.posexplode("p.candidates").alias("pos", "c")).select("week", "pool_id", "target", "pos", "c.*")


def link_rows(registry: DataFrame, column: str = "links") -> DataFrame:
    """Title, kind and URL of a map of maps."""
    return registry.select(F.explode(column).alias("title", "m")).select("title", F.explode("m").alias("kind", "url"))


def dossier_rows(spark: SparkSession, path: str, lists: list[str], entry: str) -> DataFrame:
    """The entries of several lists of each file as one row list, tagged with file and list."""
    docs = spark.read.schema(", ".join(f"{x} array<{entry}>" for x in lists)).option("multiLine", True).json(path).withColumn("_file", F.input_file_name())
    out = None
    for x in lists:
        rows = docs.select("_file", F.lit(x).alias("_key"), F.posexplode(x).alias("_pos", "e")).select("_file", "_key", "_pos", "e.*")
        out = rows if out is None else out.unionByName(rows)
    return out
