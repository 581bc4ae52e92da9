"""Content-addressed WARC archive.

``payloads`` stores the bytes of each distinct payload once, under its SHA-256.
``records`` keeps the exact header text of every record and the digest of its
payload. Joins on the digest give back the original records. Which record holds
a payload is decided on digests and ids alone; payload bytes move once, to the
record that stores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Payloads under so many bytes are never turned into revisits.
LEAST_BYTES = 100
_CRLF = "\r\n"
_NO_ID = "none"


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the archive of a page table under ``path``.

    ``date`` is the WARC-Date of all records; a page table has none, and a fixed one keeps
    archives reproducible. A null body is an empty payload, a null url an empty target
    (line ends in one are percent-encoded, as are ids of text), a null id the word ``none`` and a number in
    the headers. Rows that share an id share a record id. Of the records with equal payloads of at least
    `LEAST_BYTES` bytes the one with the smallest id is the response and the others
    revisit it; rows that repeat that id with the same payload are responses too.
    Ids of equal payloads that are all null are responses. An empty table gives an
    archive without records. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.coalesce(url_col, F.lit("")).alias("url"), F.encode(F.coalesce(body_col, F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))

    # who holds a payload: small rows, with a partial minimum before the shuffle
    light = rows.select("page_id", "url", "digest", "n_bytes")
    holders = light.groupBy("digest").agg(F.min("page_id").alias("holder"))
    known = light.join(holders, "digest")
    first = (F.col("n_bytes") < LEAST_BYTES) | F.col("page_id").eqNullSafe(F.col("holder"))
    # ids of text may hold what breaks a header
    shown = (lambda c: F.url_encode(F.col(c))) if isinstance(pages.schema[id_col].dataType, StringType) else (lambda c: F.col(c).cast("string"))
    name = lambda c: F.coalesce(shown(c), F.lit(_NO_ID))
    own = F.coalesce(shown("page_id"), F.concat(F.lit(f"{_NO_ID}:"), F.monotonically_increasing_id().cast("string")))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(_CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        line("WARC-Type", F.when(first, "response").otherwise("revisit")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), own, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.when(first, "").otherwise(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), name("holder"), F.lit(">")))),
        F.when(first, "").otherwise(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(first, F.col("n_bytes")).otherwise(0).cast("string")),
        F.lit(_CRLF),
    )
    known.select(header.alias("header"), "digest").write.parquet(f"{path}/records")

    # the bytes, once: the holder's row, or any row where all ids are null
    kept = holders.where("holder IS NOT NULL").withColumnRenamed("digest", "_digest")
    held = rows.select("page_id", "digest", "payload").join(kept, (F.col("page_id") == F.col("holder")) & (F.col("digest") == F.col("_digest")), "left_semi")
    nameless = rows.where("page_id IS NULL").select("digest", "payload").join(holders.where("holder IS NULL").select("digest"), "digest", "left_semi")
    store = held.select("digest", "payload")
    if nameless.limit(1).count():
        store = store.union(nameless)
    store.write.parquet(f"{path}/payloads-all")
    _store_once(spark, path)


def _store_once(spark: SparkSession, path: str) -> None:
    """Drop copies that only repeated ids can have left, which is rare: the usual table is read as it is."""
    table = spark.read.parquet(f"{path}/payloads-all")
    if table.groupBy("digest").count().where("count > 1").limit(1).count():
        table.dropDuplicates(["digest"]).write.parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """``digest, payload, verified``: verified says that the bytes read have the digest they are stored under."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/payloads")
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    table = spark.read.parquet(f"{path}/payloads" if there else f"{path}/payloads-all")
    return table.withColumn("verified", F.sha2("payload", 256) == F.col("digest"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Each original record with its bytes: ``header, digest, payload, record``.

    ``record`` is header, block and the closing line ends; a revisit has an empty
    block, and ``payload`` still gives the bytes it refers to.
    """
    both = spark.read.parquet(f"{path}/records").join(payloads(spark, path), "digest")
    block = F.when(_header("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return both.select("header", "digest", "payload", "verified", F.concat(F.encode("header", "UTF-8"), block, F.lit(_CRLF.encode() * 2)).alias("record"))


def index(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """What the archive says of each page, parsed from its headers and measured on the stored bytes.

    Digest and length are taken from the bytes of the payload table as read; only
    these measures are joined to the headers, so payloads are not moved again. A
    payload whose bytes don't match its digest raises an error.
    """
    stored = payloads(spark, path).select(
        F.col("digest").alias("_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("verified"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload does not match "), F.col("digest")))).alias("payload_digest"),
    )
    read = (lambda c: F.when(~c.startswith(f"{_NO_ID}:"), F.url_decode(c))) if id_type == "string" else (lambda c: c.try_cast(id_type))
    said = spark.read.parquet(f"{path}/records").select(
        read(F.regexp_extract(_header("WARC-Record-ID"), r"^<urn:page:(.*)>$", 1)).alias("page_id"),
        F.regexp_extract(_header("WARC-Payload-Digest"), r"^sha256:([0-9a-f]{64})$", 1).alias("_digest"),
        _header("WARC-Type").alias("record_type"),
        F.when(_header("WARC-Refers-To").isNotNull(), read(F.regexp_extract(_header("WARC-Refers-To"), r"^<urn:page:(.*)>$", 1))).alias("refers_to"),
    )
    return said.join(stored, "_digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
