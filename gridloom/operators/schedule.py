"""The schedule lake: captures to one civil-time programme table, its conflicts and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.calendar import is_night

SLOT = ["date", "start_min", "channel"]


def newest_capture(captures: DataFrame, as_of: Column, ttl_hours: int = 24) -> DataFrame:
    """Per source key the newest valid capture; a stale or failed one only where nothing better exists, flagged in ``state``."""
    key = F.sha2(F.to_json(F.struct("adapter", "url", "channel", "date")), 256)
    age = F.unix_timestamp(as_of) - F.unix_timestamp("fetched_at")
    best = Window.partitionBy("source_key").orderBy(F.desc("ok"), F.desc("fetched_at"), "url")
    out = captures.withColumn("source_key", key).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    return out.withColumn("state", F.when(~F.col("ok"), "failed").when(age <= ttl_hours * 3600, "fresh").otherwise("stale"))


def distinct_observations(obs: DataFrame, order: str = "plan_pos") -> DataFrame:
    """One observation per date, start, channel, title and source, the first in plan order."""
    keys = ["date", "start", "channel", "title", "source_url"]
    rest = [c for c in obs.columns if c not in keys]
    return obs.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in rest])


def source_plan(channels: DataFrame, first: Column, today: Column, pages: int = 1) -> DataFrame:
    """Channels by dates by pages, with ``reachable`` for dates 1 to 13 days ahead."""
    dates = channels.select("*", F.explode(F.sequence(F.date_sub(first, 1), F.date_add(first, 6))).alias("date"))
    out = dates.select("*", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page"))
    return out.withColumn("reachable", F.datediff("date", today).between(1, 13))


def learnt_plan(inventory: DataFrame, first: Column) -> DataFrame:
    """URL templates of past rows, issued again for the dates of a week."""
    template = F.replace(F.col("source_url"), F.col("date").cast("string"), F.lit("{date}"))
    known = inventory.where(F.contains("source_url", F.col("date").cast("string"))).select("adapter", "channel", template.alias("template")).distinct()
    days = known.select("*", F.explode(F.sequence(first, F.date_add(first, 6))).alias("date"))
    return days.withColumn("url", F.replace("template", F.lit("{date}"), F.col("date").cast("string")))


def rollover(rows: DataFrame, capture: str = "capture_id", pos: str = "pos", evening: int = 1080, morning: int = 360) -> DataFrame:
    """Civil day offset of ordered times: the first step back begins the next day.

    ``rollover_error`` tells a second step back, or one that doesn't lead from the
    evening to the early morning.
    """
    w = Window.partitionBy(capture).orderBy(pos)
    prev = F.lag("start_min").over(w)
    out = rows.withColumn("_back", F.when(F.col("start_min") < prev, 1).otherwise(0)).withColumn("_odd", (F.col("_back") == 1) & ((prev < evening) | (F.col("start_min") >= morning)))
    out = out.withColumn("day_offset", F.sum("_back").over(w))
    error = F.when(F.col("_odd"), "implausible").when((F.col("_back") == 1) & (F.col("day_offset") > 1), "second_rollover")
    return out.withColumn("rollover_error", error).drop("_back", "_odd")


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``is_duplicate`` for all but the first row of a key in a stated order."""
    return rows.withColumn("is_duplicate", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) > 1)


def longest_gaps(rows: DataFrame) -> DataFrame:
    """Longest gap between consecutive starts, and the first daytime start, per channel and day."""
    w = Window.partitionBy("channel", "date").orderBy("start_min")
    gap = F.col("start_min") - F.lag("start_min").over(w)
    return rows.withColumn("_gap", gap).groupBy("channel", "date").agg(
        F.max("_gap").alias("longest_gap"), F.min(F.when(~is_night(F.col("start_min")), F.col("start_min"))).alias("first_day_start"), F.max(is_night(F.col("start_min")).cast("int")).alias("has_night"),
    )


def printed_scope(rows: DataFrame) -> DataFrame:
    """Days, night days, and lower medians of first start and longest gap, per channel. A day with one start has a gap of 0."""
    low = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").cast("int")
    return longest_gaps(rows).na.fill(0, ["longest_gap"]).groupBy("channel").agg(F.count("*").alias("days"), F.sum("has_night").cast("long").alias("night_days"), low("first_day_start").alias("first_start"), low("longest_gap").alias("gap"))


def scope_limits(scope: DataFrame, evening: int = 1020, gap: int = 240) -> DataFrame:
    """A10: evening-only channels, others that have long gaps, those without a night. Without a daytime start a channel is neither of the first two."""
    codes = F.array_compact(F.array(F.when(F.col("first_start") >= evening, "evening_only"), F.when((F.col("gap") > gap) & (F.col("first_start") < evening), "long_gap"), F.when(F.col("night_days") == 0, "no_night")))
    return scope.select("channel", F.explode(codes).alias("limit"))


def channel_counts(rows: DataFrame) -> DataFrame:
    """Rows and sorted hosts per date and channel."""
    return rows.groupBy("date", "channel").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def append_new(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, one each; a replay adds nothing."""
    return new.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")


def slot_conflicts(new: DataFrame, saved: DataFrame) -> DataFrame:
    """New rows whose slot holds another title among the saved rows."""
    have = saved.select(*SLOT, F.col("title_key").alias("saved_title")).distinct()
    return new.join(have, SLOT).where("title_key <> saved_title")


def not_only_stale(obs: DataFrame, captures: DataFrame) -> DataFrame:
    """Observations except those whose captures are all stale."""
    bad = captures.groupBy("source_key").agg(F.bool_and(F.col("status") == "stale").alias("stale")).where("stale").select("source_key")
    return obs.join(bad, "source_key", "left_anti")


def slots(obs: DataFrame, scope: str = "scope") -> DataFrame:
    """Observations of one scope, slot and title: their sources and how many were duplicates."""
    return obs.groupBy(scope, *SLOT, "title_key").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("origins"), F.count("*").alias("n"), (F.count("*") - 1).alias("duplicates"))


def event_conflicts(obs: DataFrame) -> DataFrame:
    """Slots with several titles, unless all resolve to one same work."""
    out = obs.groupBy(*SLOT).agg(F.countDistinct("title_key").alias("titles"), F.countDistinct("work_id").alias("works"), F.max(F.col("work_id").isNull().cast("int")).alias("open"))
    return out.withColumn("conflict", (F.col("titles") > 1) & ~((F.col("works") == 1) & (F.col("open") == 0))).drop("open")


def near_time(rows: DataFrame) -> DataFrame:
    """Pairs of starts of one title on one channel and day that differ, as (earlier, later); neighbours in time only."""
    w = Window.partitionBy("date", "channel", "title_key").orderBy("start_min")
    one = rows.select("date", "channel", "title_key", "start_min").distinct()
    return one.withColumn("next_start", F.lead("start_min").over(w)).where("next_start IS NOT NULL")


def inventory_quality(rows: DataFrame, least_rows: int, least_channels: int) -> DataFrame:
    """Rows, sources, channels, night rows, malformed rows and whether the minimums are met, per week and date."""
    bad = F.col("start_min").isNull() | F.col("channel").isNull() | (F.coalesce(F.trim("title"), F.lit("")) == "")
    out = rows.groupBy("week", "date").agg(
        F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_sources"), F.countDistinct("channel").alias("n_channels"),
        F.sum(F.coalesce(is_night(F.col("start_min")), F.lit(False)).cast("long")).alias("night_rows"), F.sum(bad.cast("long")).alias("malformed"),
    )
    return out.withColumn("meets", (F.col("n_rows") >= least_rows) & (F.col("n_channels") >= least_channels))


def pagination_gaps(results: DataFrame) -> DataFrame:
    """Per source and date the missing page numbers, and whether the products add up to the declared total."""
    g = results.groupBy("source", "date").agg(F.max("total_pages").alias("total"), F.collect_set("page").alias("pages"), F.sum("n").alias("n"), F.max("total_products").alias("declared"))
    missing = F.array_except(F.when(F.col("total") >= 1, F.sequence(F.lit(1), F.col("total"))).otherwise(F.array().cast("array<int>")), F.col("pages"))
    return g.select("source", "date", F.array_join(F.array_sort(missing).cast("array<string>"), ",").alias("missing"), (F.col("n") != F.col("declared")).alias("total_differs"))


def required_matrix(required: DataFrame, days: DataFrame, actual: DataFrame, keys: tuple[str, str] = ("channel", "date")) -> DataFrame:
    """Pairs of required channel and day without a row. The required list is a configuration and its size is that of the two dimensions."""
    return required.select(keys[0]).distinct().crossJoin(F.broadcast(days.select(keys[1]).distinct())).join(actual.select(*keys).distinct(), list(keys), "left_anti")


def declared_vs_actual(declared: DataFrame, rows: DataFrame) -> DataFrame:
    """Channels whose declared count differs from the rows; either side may lack the channel."""
    actual = rows.groupBy("date", "channel").agg(F.count("*").alias("actual"))
    both = declared.join(actual, ["date", "channel"], "full_outer")
    return both.where(~F.col("declared").eqNullSafe(F.col("actual"))).select("date", "channel", "declared", "actual")


def review_sample(rows: DataFrame, per_page: int = 3) -> DataFrame:
    """Per page the first row, the first of prime time, the first of the night, filled up in order.

    Each class is cut to what it can give, which Spark does before the shuffle; only a
    few rows of a page are ranked together.
    """
    first = lambda df, n, o: df.withColumn("_r", F.row_number().over(Window.partitionBy("page_key").orderBy("start_min", "row_id"))).where(F.col("_r") <= n).withColumn("_o", o).drop("_r")
    any_row = first(rows, per_page, F.when(F.col("_r") == 1, 0).otherwise(3))
    some = any_row.unionByName(first(rows.where(F.col("start_min").between(1230, 1350)), 1, F.lit(1))).unionByName(first(rows.where(is_night(F.col("start_min"))), 1, F.lit(2)))
    once = some.withColumn("_k", F.row_number().over(Window.partitionBy("page_key", "row_id").orderBy("_o"))).where("_k = 1")
    pick = F.row_number().over(Window.partitionBy("page_key").orderBy("_o", "start_min", "row_id"))
    return once.withColumn("pick", pick).where(F.col("pick") <= per_page).drop("_o", "_k")


def stratified_review(rows: DataFrame, per_day: int = 5) -> DataFrame:
    """Per day the densest page not used on an earlier day of the week, ``per_day`` rows spread evenly over it, channels not repeated on the first pass. A day whose pages are all used is passed over; rows between the spread ones never fill up.

    Only the choice of pages depends on the days before it: it is a fold over the page
    counts of a week, one array of them a week. Their rows are ranked in windows. Of
    pages of one size the first by name is taken; rows without a page take no part.
    """
    cols = ["week", "date", "page_key", "channel", "start_min", "row_id"]
    rows = rows.where(F.col("page_key").isNotNull()).select(*cols)
    sizes = rows.groupBy("week", "date", "page_key").agg((-F.count("*")).alias("minus"))
    days = sizes.groupBy("week", "date").agg(F.sort_array(F.collect_list(F.struct("minus", "page_key"))).alias("pages"))
    week = days.groupBy("week").agg(F.sort_array(F.collect_list(F.struct("date", "pages"))).alias("days"))
    none = F.array().cast(f"array<struct<date:{dict(rows.dtypes)['date']},page_key:{dict(rows.dtypes)['page_key']}>>")

    def choose(taken: Column, day: Column) -> Column:
        free = F.filter(day["pages"], lambda p: ~F.exists(taken, lambda t: t["page_key"] == p["page_key"]))
        chosen = F.transform(F.slice(free, 1, 1), lambda p: F.struct(day["date"].alias("date"), p["page_key"].alias("page_key")))
        return F.concat(taken, chosen)

    chosen = week.select("week", F.explode(F.aggregate("days", none, choose)).alias("c")).select("week", "c.*")
    here = rows.join(chosen, ["week", "date", "page_key"])
    day = Window.partitionBy("week", "date")
    order = [F.col("start_min"), F.col("row_id")]
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(day) / per_day))
    here = here.withColumn("_i", F.row_number().over(day.orderBy(*order)) - 1).withColumn("_spread", F.col("_i") % step == 0)
    again = F.row_number().over(Window.partitionBy("week", "date", "_spread", "channel").orderBy("_i")) > 1
    here = here.withColumn("_tier", again.cast("int")).where("_spread")
    return here.withColumn("_r", F.row_number().over(day.orderBy("_tier", "_i"))).where(F.col("_r") <= per_day).select(*cols)


def apply_grid_review(rows: DataFrame, corrections: DataFrame, additions: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Titles corrected by exact row, then by pattern, rows added, with ``n_channel`` recounted and duplicates flagged."""
    out = rows.join(corrections.withColumnRenamed("title", "_new"), [*SLOT, "row_id"], "left").withColumn("title", F.coalesce("_new", "title")).drop("_new")
    for old, new in patterns:
        out = out.withColumn("title", F.regexp_replace("title", old, new))
    out = out.unionByName(additions, allowMissingColumns=True)
    per = Window.partitionBy("date", "channel")
    return out.withColumn("n_channel", F.count("*").over(per)).withColumn("is_duplicate", F.row_number().over(Window.partitionBy(*SLOT, "title").orderBy("row_id")) > 1)
