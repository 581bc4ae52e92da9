"""Audits of issues, pools and manifests, as rows of errors and sums of flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.calendar import week_of_saturday
from gridloom.functions.keys import match_key


def calendar_audit(issues: DataFrame) -> DataFrame:
    """per issue whether its id is that of its Saturday, it ends on Friday, it advances, and how many weeks were skipped before it.

    One row a week: the order over issues is small whatever the corpus.
    """
    prev = F.lag("from").over(Window.orderBy("from"))
    days = F.datediff(F.col("from"), prev)
    return issues.select(
        "week", (F.col("week") == week_of_saturday(F.col("from"))).alias("id_ok"), ((F.weekday("from") == 5) & (F.datediff("to", "from") == 6)).alias("span_ok"),
        F.coalesce(days > 0, F.lit(True)).alias("advances"), F.coalesce(F.greatest(F.lit(0), F.floor(days / 7).cast("int") - 1), F.lit(0)).alias("skipped"),
    )


def manifest_audit(manifest: DataFrame, pages: DataFrame, most_cards: int) -> DataFrame:
    """manifest against issues: weeks on one side only, repeated weeks, differing page counts, pages with too many cards."""
    m = manifest.groupBy("week").agg(F.count("*").alias("entries"), F.max("page_count").alias("declared"))
    p = pages.groupBy("week").agg(F.countDistinct("page_id").alias("actual"), F.max("cards").alias("most"))
    j = m.join(p, "week", "full_outer")
    codes = F.array_compact(F.array(
        F.when(F.col("entries").isNull(), "not_in_manifest"), F.when(F.col("actual").isNull(), "no_issue"), F.when(F.col("entries") > 1, "repeated"),
        F.when(F.col("declared") != F.col("actual"), "page_count"), F.when(F.col("most") > most_cards, "too_many_cards"),
    ))
    return j.select("week", F.explode(codes).alias("problem"))


def readiness(pool: DataFrame, ready: Column) -> DataFrame:
    """Complete candidates and complete reserves per pool and in all, in one roll-up."""
    g = pool.withColumn("_r", ready.cast("long")).rollup("pool_id").agg(
        F.count("*").alias("n"), F.sum("_r").alias("n_ready"), F.sum(F.when(F.col("rank") > F.col("target"), F.col("_r")).otherwise(0)).alias("ready_reserves"), F.grouping("pool_id").cast("int").alias("all_pools"),
    )
    return g


def candidate_problems(pool: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """What candidates lack: ``pool_id, work_id, rank, problem``, a row for each check that fails or can't be told. The candidates without a row are the ready ones of `readiness`."""
    lacks = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return pool.select("pool_id", "work_id", "rank", F.explode(lacks).alias("problem"))


def repeated(rows: DataFrame, check: str, scope: list[str], key: list[Column]) -> DataFrame:
    """Keys that occur more than once in their scope: ``check, scope, key, n``. Rows with a null in the key take no part; keys are counted in a partial aggregate first."""
    keyed = rows.select(F.concat_ws("|", *scope).alias("scope"), F.when(~F.array_contains(F.transform(F.array(*[k.cast("string") for k in key]), lambda k: k.isNull()), True), F.concat_ws("|", *key)).alias("key")).where("key IS NOT NULL")
    return keyed.groupBy("scope", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(check).alias("check"), "scope", "key", "n")


def duplicates(headliners: DataFrame, programmes: DataFrame, works: DataFrame, pools: DataFrame, pages: DataFrame) -> DataFrame:
    """What must not occur twice: headliners of an issue over its days, programme rows of a day, works (by id, and by title, year and kind), legacy ids, ranks of a pool, pages of an issue."""
    key = lambda c: match_key(F.col(c))
    year = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = [
        repeated(headliners, "headliner", ["week"], [key("title")]), repeated(programmes, "programme", ["date"], [key("title"), key("channel"), F.col("start")]),
        repeated(works, "work_id", [], [F.col("id")]), repeated(works, "work_title", [], [key("title"), year("year"), year("kind")]),
        repeated(works.select(F.explode("legacy_ids").alias("legacy")), "legacy_id", [], [F.col("legacy")]),
        repeated(pools, "rank", ["pool_id"], [F.col("rank")]), repeated(pages, "page_id", ["week"], [F.col("page_id")]),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def pool_summary(pool: DataFrame, primaries: DataFrame) -> DataFrame:
    """Per pool its size, whether ranks are 1..n, and how many primaries it lacks."""
    g = pool.groupBy("pool_id").agg(F.count("*").alias("n"), ((F.min("rank") == 1) & (F.max("rank") == F.count("*")) & (F.countDistinct("rank") == F.count("*"))).alias("ranks_ok"))
    lost = primaries.join(pool.select("pool_id", "work_id"), ["pool_id", "work_id"], "left_anti").groupBy("pool_id").agg(F.count("*").alias("missing_primaries"))
    return g.join(lost, "pool_id", "left").na.fill(0, ["missing_primaries"])


def ratio(rows: DataFrame, by: list[str], **flags: Column) -> DataFrame:
    """Shares of true flags in per cent, half up; 0 for an empty group."""
    pct = lambda c: F.coalesce(F.floor(100.0 * F.sum(F.coalesce(c, F.lit(False)).cast("long")) / F.nullif(F.count("*"), F.lit(0)) + 0.5), F.lit(0)).cast("long")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[pct(c).alias(k) for k, c in flags.items()])


def host_diversity(rows: DataFrame, least: int = 2) -> DataFrame:
    """days whose rows come from fewer than ``least`` hosts and cite no provided document."""
    g = rows.groupBy("date").agg(F.countDistinct("host").alias("hosts"), F.coalesce(F.bool_or("document"), F.lit(False)).alias("document"))
    return g.where(~F.col("document") & (F.col("hosts") < least)).select("date", "hosts")


def country_names(rows: DataFrame, names: DataFrame, pinned: dict[str, str]) -> DataFrame:
    """French country names by code: pinned ones first, then the dimension, then the name as it is."""
    fixed = F.try_element_at(F.create_map(*[F.lit(x) for kv in (pinned or {"": ""}).items() for x in kv]), F.col("iso"))
    return rows.join(names.select("iso", F.col("name_fr")), "iso", "left").withColumn("country_fr", F.coalesce(fixed, F.col("name_fr"), F.col("name"))).drop("name_fr")


def signal_order(signals: DataFrame) -> DataFrame:
    """Signals with their place in the day: mark from high to low, then start."""
    return signals.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "start_min", "signal_id")))
