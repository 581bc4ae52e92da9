"""Freshness over issues: what is new, what repeats, where titles were exposed, and the radar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def issue_sequence(issues: DataFrame) -> DataFrame:
    """Issues in order of their first day with ``issue_seq`` from 1. There is one row a week: the table is small whatever the corpus."""
    return issues.select("week", "from").distinct().withColumn("issue_seq", F.row_number().over(Window.orderBy("from")))


def repeats(titles: DataFrame, seq: DataFrame, lookback: int) -> DataFrame:
    """Each title of an issue with ``last_seq``, its latest issue among the ``lookback`` ones before, or null.

    A title's previous issue is the row before it in its own order, so no issue is
    held against each of the others: one shuffle by title.
    """
    rows = titles.select("week", "title_key").distinct().join(F.broadcast(seq.select("week", "issue_seq")), "week")  # one row a week
    prev = F.lag("issue_seq").over(Window.partitionBy("title_key").orderBy("issue_seq"))
    return rows.withColumn("_prev", prev).withColumn("last_seq", F.when(F.col("issue_seq") - F.col("_prev") <= lookback, F.col("_prev"))).drop("_prev")


def fresh_ratio(titles: DataFrame, seq: DataFrame, lookback: int = 4) -> DataFrame:
    """Titles, new titles, repeats of the issue just before, and the share of new ones in per cent (100 for none), per issue."""
    r = repeats(titles, seq, lookback)
    g = r.groupBy("week", "issue_seq").agg(
        F.count("*").alias("n_titles"), F.sum(F.col("last_seq").isNull().cast("long")).alias("n_new"), F.sum(F.coalesce(F.col("last_seq") == F.col("issue_seq") - 1, F.lit(False)).cast("long")).alias("n_repeat"),
    )
    return g.withColumn("fresh_pct", F.floor(100.0 * F.col("n_new") / F.col("n_titles") + 0.5).cast("long"))


def exposure(public: DataFrame, reserve: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Scopes in which a title appeared, per week."""
    every = public.select("title_key", "week", F.lit("public").alias("scope")).unionByName(reserve.select("title_key", "week", F.lit("reserve").alias("scope"))).unionByName(occurrences.select("title_key", "week", F.lit("occurrence").alias("scope")))
    return every.groupBy("title_key", "week").agg(F.array_join(F.array_sort(F.collect_set("scope")), ",").alias("scopes"))


def core_titles(cards: DataFrame, grid: DataFrame, pool: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Public and reserve titles of each issue; occurrences stand in where an issue has neither."""
    public = cards.select("week", "title_key").union(grid.select("week", "title_key")).union(pool.where("rank <= target").select("week", "title_key")).distinct().withColumn("core", F.lit("public"))
    reserve = pool.where("rank > target").select("week", "title_key").distinct().withColumn("core", F.lit("reserve"))
    both = public.unionByName(reserve)
    lacking = occurrences.select("week", "title_key").distinct().join(both.select("week").distinct(), "week", "left_anti").withColumn("core", F.lit("public"))
    return both.unionByName(lacking)


def repeats_of_previous(titles: DataFrame, seq: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Titles also in the issue just before, without the excepted ones."""
    now = titles.select("week", "title_key").distinct().join(F.broadcast(seq.select("week", "issue_seq")), "week").select("issue_seq", "title_key")
    before = now.select((F.col("issue_seq") + 1).alias("issue_seq"), "title_key")
    return now.intersect(before).exceptAll(exceptions.select("issue_seq", "title_key").distinct().intersect(now.intersect(before)))


def radar_reconcile(rows: DataFrame) -> DataFrame:
    """Of each work the first place stays by (precedence, rank); others go, with a reason. Works with conflicting explicit versions are held.

    ``rows`` has ``row_id, work_id, precedence, rank, version``; rows without a work stay,
    each by itself, and meet in no group. A work's first place and versions are
    aggregated and joined to its rows.
    """
    first = F.min(F.struct("precedence", "rank", "row_id"))
    works = rows.where("work_id IS NOT NULL").groupBy(F.col("work_id").alias("_work")).agg(F.countDistinct("version").alias("_v"), first.alias("_first"))
    out = rows.join(works, F.col("work_id") == F.col("_work"), "left")
    decision = (
        F.when(F.col("work_id").isNull(), "keep_unresolved").when(F.col("_v") > 1, "hold_version_conflict").when(F.col("row_id") == F.col("_first.row_id"), "keep")
        .when(F.col("_first.precedence") == F.col("precedence"), "remove_same_pool").otherwise("remove_earlier_pool")
    )
    return out.select(*rows.columns, F.coalesce("_first.row_id", "row_id").alias("kept_at"), decision.alias("decision"))


def radar_deficits(rows: DataFrame, minimum: dict[str, int]) -> DataFrame:
    """Distinct works per pool and what is missing to its minimum."""
    need = rows.sparkSession.createDataFrame(list(minimum.items()), "pool string, least int")
    g = rows.groupBy("pool").agg(F.countDistinct("work_id").alias("works"))
    return need.join(g, "pool", "left").select("pool", F.coalesce("works", F.lit(0)).alias("works"), F.greatest(F.lit(0), F.col("least") - F.coalesce("works", F.lit(0))).alias("deficit"))


def lower_depth(pool: DataFrame) -> DataFrame:
    """Cards, distinct works and reserve depth per section."""
    return pool.groupBy("section").agg(F.count("*").alias("cards"), F.countDistinct("work_id").alias("works"), F.sum((F.col("rank") > F.col("target")).cast("long")).alias("depth"))
