"""The engine's frames over the driver's tables, each with the same frame in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.calendar import issue_from, week_of_saturday
from gridloom.functions.keys import fresh_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as works: brands are directors, types genres, sizes years from 1950."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("director"), F.col("p_type").alias("genre"), (F.col("p_size") + 1950).alias("year"), F.col("p_partkey").alias("pos"))


WORKS = "works AS (SELECT p_partkey AS id, p_name AS title, p_brand AS director, p_type AS genre, p_size + 1950 AS year, p_partkey AS pos FROM part)"


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as occurrences of a titled work in an issue."""
    day = F.col("l_shipdate").cast("date")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), issue_from(day).alias("from"), F.col("l_suppkey").alias("pool_id"), F.col("l_quantity").alias("qty"))
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), fresh_key(F.concat_ws(" ", "p_name", "p_brand")).alias("title_key"))
    return li.join(named, "id").withColumn("week", week_of_saturday(F.col("from")))


_KEY = "trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', ' ', 'g'))"
OCC = f"""occ0 AS (SELECT l_partkey AS id, CAST(l_shipdate AS DATE) - CAST((isodow(l_shipdate) + 1) % 7 AS INTEGER) AS "from", l_suppkey AS pool_id, l_quantity AS qty FROM lineitem),
occ AS (SELECT o.*, {_KEY.format("p_name || ' ' || p_brand")} AS title_key, strftime("from" + 2, '%G-S%V') AS week FROM occ0 o JOIN part ON id = p_partkey)"""


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as programme rows: types are channels, the number in ``props`` the title."""
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), ts.cast("date").alias("date"), (F.hour(ts) * 60 + F.minute(ts)).alias("start_min"), F.col("event_type").alias("channel"),
        F.concat(F.lit("title "), (k % 20).cast("string")).alias("title"), F.concat(F.lit("title "), (k % 20).cast("string")).alias("title_key"), F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source"),
        F.when(k % 3 != 0, k % 20).alias("work_id"), k.alias("k"), F.col("user_id"), ts.alias("ts"), F.lit("all").alias("scope"),
    )


SCHED = """sched AS (SELECT event_id AS row_id, CAST(ts AS DATE) AS date, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS start_min, event_type AS channel, CAST(props->>'$.k' AS INTEGER) AS k,
 'title ' || CAST(CAST(props->>'$.k' AS INTEGER) % 20 AS VARCHAR) AS title, 'title ' || CAST(CAST(props->>'$.k' AS INTEGER) % 20 AS VARCHAR) AS title_key, 'src' || CAST(user_id % 7 AS VARCHAR) AS source,
 CASE WHEN CAST(props->>'$.k' AS INTEGER) % 3 <> 0 THEN CAST(props->>'$.k' AS INTEGER) % 20 END AS work_id, user_id, ts, 'all' AS scope FROM events)"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' parts per supplier as ranked pools: by quantity, targets of 5."""
    from pyspark.sql import Window

    # dealt by pool, for the sums and the ranks alike: one shuffle
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").repartition("l_suppkey")
    g = li.groupBy(F.col("l_suppkey").alias("pool_id"), F.col("l_partkey").alias("work_id")).agg(F.sum("l_quantity").cast("long").alias("qty"))
    rank = F.row_number().over(Window.partitionBy("pool_id").orderBy(F.desc("qty"), "work_id"))
    return g.withColumn("rank", rank).withColumn("target", F.lit(5))


POOL = """pool0 AS (SELECT l_suppkey AS pool_id, l_partkey AS work_id, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY ALL),
pool AS (SELECT *, CAST(row_number() OVER (PARTITION BY pool_id ORDER BY qty DESC, work_id) AS INTEGER) AS rank, 5 AS target FROM pool0)"""


def line_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as links of seven kinds: flag and status tell pages of works from other pages and whole from broken urls, prices, parts and orders are the ids."""
    of = lambda a, n, r: F.when(F.col("l_returnflag") == "A", a).when(F.col("l_returnflag") == "N", n).otherwise(r)
    full = lambda yes, no: F.when(F.col("l_linestatus") == "F", yes).otherwise(no)
    part, cents = F.col("l_partkey").cast("string"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")
    host = F.concat(F.lit("http://studio"), F.col("l_suppkey").cast("string"), F.lit(".example.org/"))
    made = {
        "imdb": ("https://www.imdb.com/", of("title/tt", "fr/title/tt", "name/tt"), cents, full("/", "")),
        "tmdb": ("https://www.themoviedb.org/", of("movie/", "tv/", "person/"), part, full("-titre", "?x=1")),
        "sc": ("https://www.senscritique.com/", of("film", "serie", "album"), F.concat(F.lit("/x"), part), full(F.concat(F.lit("/"), cents), F.lit(""))),
        "allocine": ("https://www.allocine.fr/", of("film/fichefilm_gen_cfilm=", "series/ficheserie_gen_cserie=", "personne/fichepersonne_gen_cpersonne="), part, F.lit(".html")),
        "wikidata": ("https://www.wikidata.org/wiki/", of("Q", "Property:P", "Q"), F.col("l_orderkey").cast("string"), full("", "#x")),
        "wikipedia": ("https://", of("fr", "en", "de"), F.concat(F.lit(".wikipedia.org/wiki/Film_"), part), full("", "?action=raw")),
        "official": ("", of(full("https://m.Facebook.com/p", "https://notgoogle.com/"), host, F.lit("ftp://studio.example.org/")), F.lit(""), F.lit("")),
    }
    kind, url = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, (start, *rest)) in enumerate(made.items(), 1):
        kind, url = F.when(F.col("l_linenumber") == k, name).otherwise(kind), F.when(F.col("l_linenumber") == k, F.concat(F.lit(start), *rest)).otherwise(url)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"), url.alias("url"))


#: What `line_links` is made of, for SQL that says what each case gives.
LINKS = """l AS (SELECT l_orderkey, l_linenumber, l_linenumber AS k, l_returnflag AS f, l_linestatus = 'F' AS whole, CAST(l_partkey AS VARCHAR) AS part, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS cents, l_orderkey AS o FROM lineitem)"""
