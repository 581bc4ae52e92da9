"""Reader queries: statistics, facets, calendars, watch-lists and top-N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.keys import fresh_key
from gridloom.functions.parse import split_directors


def totals(works: DataFrame) -> DataFrame:
    """Works, enriched works, distinct directors and distinct weeks, in one row."""
    weeks = F.transform(F.coalesce("occurrences", F.array().cast("array<struct<week:string>>")), lambda o: o["week"])
    base = works.agg(F.count("*").alias("works"), F.sum((F.coalesce(F.size("ratings"), F.lit(0)) > 0).cast("long")).alias("enriched"))
    people = works.select(F.explode(split_directors(F.col("director"))).alias("x")).agg(F.countDistinct("x").alias("directors"))
    issues = works.select(F.explode(weeks).alias("x")).agg(F.countDistinct("x").alias("weeks"))
    return base.crossJoin(people).crossJoin(issues)  # one row each


def top_share(rows: DataFrame, key: str, n: int = 12) -> DataFrame:
    """The ``n`` most frequent values with their share of the maximum in per cent."""
    top = rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)
    return top.withColumn("pct", F.floor(100.0 * F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1))) + 0.5).cast("long"))  # n rows


def by_director(works: DataFrame) -> DataFrame:
    """Works per director with their sorted ids. A director's list is as long as their works."""
    each = works.select("id", F.explode(split_directors(F.col("director"))).alias("person"))
    return each.groupBy("person").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.lpad(F.col("id").cast("string"), 10, "0"))), ",").alias("ids"))


def facets(works: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of every facet with counts, in one pass over grouping sets."""
    g = works.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    full = (1 << len(columns)) - 1
    name = F.coalesce(*[F.when(F.col("g") == (full ^ (1 << (len(columns) - 1 - k))), F.lit(c)) for k, c in enumerate(columns)])
    return g.select(name.alias("facet"), F.coalesce(*[F.col(c).cast("string") for c in columns]).alias("value"), "n").where("value IS NOT NULL")


def editions(rows: DataFrame) -> DataFrame:
    """Works with more than one edition, with their sorted editions."""
    return rows.groupBy("work").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("edition")), ",").alias("editions")).where("n > 1")


def per_date(events: DataFrame) -> DataFrame:
    """Events per date."""
    return events.groupBy("date").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def release_events(physical: DataFrame, streaming: DataFrame, expirations: DataFrame) -> DataFrame:
    """Three release lists as one timeline."""
    tag = lambda df, kind: df.withColumn("kind", F.lit(kind))
    return tag(physical, "physical").unionByName(tag(streaming, "streaming"), allowMissingColumns=True).unionByName(tag(expirations, "expiration"), allowMissingColumns=True)


def watch_alerts(watch: DataFrame, releases: DataFrame) -> DataFrame:
    """Releases of watched titles."""
    r = releases.withColumn("_k", fresh_key(F.col("work")))
    return watch.withColumn("_k", fresh_key(F.col("title"))).join(r, "_k").drop("_k")


def catalogue_order(kind: str) -> list[Column]:
    """Sort keys by title, recent week, director (nulls last as ``zzz``) or frequency; ids break ties."""
    title = F.collate("title", "fr")
    return {
        "title": [title, F.col("id")], "recent": [F.desc(F.element_at("occurrences", -1)["week"]), title, F.col("id")],
        "director": [F.coalesce("director", F.lit("zzz")), title, F.col("id")], "frequency": [F.desc(F.size("occurrences")), title, F.col("id")],
    }[kind]


def watch_order(kind: str = "priority") -> list[Column]:
    """By priority then newest, by title, or newest first."""
    return {"priority": [F.coalesce("priority", F.lit(1)).desc(), F.desc("added"), F.col("title_key")], "title": [F.col("title_key")], "recent": [F.desc("added"), F.col("title_key")]}[kind]


def latest_issue(manifest: DataFrame) -> DataFrame:
    """The manifest's latest issue if it is published, else the newest published one."""
    pub = manifest.where("status <> 'draft'")
    return pub.agg(F.coalesce(F.max(F.when(F.col("is_latest"), F.col("week"))), F.max_by("week", "issue_seq")).alias("week"))


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows lost and added between two tables, as ``side, …``; empty if they are equal as multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("lost")).unionByName(b.exceptAll(a).withColumn("side", F.lit("added")))


def same_set(a: Column, b: Column) -> Column:
    """Equal as sets."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def ordered_union(*lists: Column) -> Column:
    """Distinct elements of several lists in order."""
    return F.array_distinct(F.concat(*lists))


def visual_titles(*sources: DataFrame) -> DataFrame:
    """Distinct titles of several sources."""
    out = sources[0].select("week", "title_key")
    for s in sources[1:]:
        out = out.union(s.select("week", "title_key"))
    return out.distinct()
