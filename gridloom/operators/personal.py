"""Seen-aware recommendations per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.identity import seen_keys, without_seen
from gridloom.staging import small, staged


def visible(cards: DataFrame, seen: DataFrame, target: str = "target") -> DataFrame:
    """Per user and pool the unseen primaries, then the best unseen eligible reserves, up to the target. ``slot`` is the place.

    ``cards`` has a row per user: ``user_id, pool_id, work_id, title, rank, target, eligible``.
    """
    left = without_seen(cards, seen).withColumn("is_reserve", F.col("rank") > F.col(target)).where("NOT is_reserve OR eligible")
    order = Window.partitionBy("user_id", "pool_id").orderBy("is_reserve", "rank", "work_id")
    return left.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= F.col(target))


def grid_refill(cards: DataFrame, seen: DataFrame, reserves: DataFrame, capacity: int) -> DataFrame:
    """Editorial order without the seen, reserves after it, pages of ``capacity``."""
    both = cards.withColumn("_o", F.lit(0)).unionByName(reserves.withColumn("_o", F.lit(1)))
    left = without_seen(both, seen)
    out = left.withColumn("slot", F.row_number().over(Window.partitionBy("user_id").orderBy("_o", "pos", "work_id"))).drop("_o")
    return out.withColumn("page", F.ceil(F.col("slot") / capacity).cast("int"))


def library_row(rows: DataFrame, target: str = "target") -> DataFrame:
    """Unplayed primaries, then unplayed resolved reserves, then played primaries again where reserves don't suffice."""
    primary = F.col("rank") <= F.col(target)
    tier = F.when(primary & ~F.col("played"), 0).when(~primary & ~F.col("played") & F.col("resolved"), 1).when(primary, 2)
    out = rows.withColumn("tier", tier).where("tier IS NOT NULL")
    return out.withColumn("slot", F.row_number().over(Window.partitionBy("user_id", "pool_id").orderBy("tier", "rank"))).where(F.col("slot") <= F.col(target))


def first_cards(asked: DataFrame, pools: DataFrame, key: list[str], width: int = 16) -> DataFrame:
    """The first ``upto`` rows by ``place`` (from 1) of each pool that ``asked`` names by ``key``.

    Places are cut into stretches of ``width`` and both sides meet by pool and stretch:
    rows beyond what is asked of a pool aren't joined at all.
    """
    wanted = asked.where("upto > 0").withColumn("_stretch", F.explode(F.sequence(F.lit(0), F.floor((F.col("upto") - 1) / width).cast("int"))))
    laid = pools.withColumn("_stretch", F.floor((F.col("place") - 1) / width).cast("int"))
    return wanted.join(laid, [*key, "_stretch"]).where("place <= upto").drop("_stretch")


def visible_cards(follows: DataFrame, pools: DataFrame, seen: DataFrame) -> DataFrame:
    """W07 for users by the pools they follow (``user_id, pool_id``), without building each user's whole pools.

    A page takes ``target`` cards and passes over one card for each key that its user
    has seen, so that the first ``target`` plus so many cards that may be shown are all
    that it can use. ``pools`` has ``pool_id, work_id, title, rank, target, eligible``;
    its works and titles are distinct within a pool.
    """
    may = pools.where("rank <= target OR eligible")
    laid = may.withColumn("place", F.row_number().over(Window.partitionBy("pool_id").orderBy(F.col("rank") > F.col("target"), "rank", "work_id")))
    passed = seen_keys(seen).groupBy("user_id").agg(F.count("*").alias("_n"))
    targets = pools.groupBy("pool_id").agg(F.max("target").alias("_t"))
    asked = follows.select("user_id", "pool_id").distinct().join(targets, "pool_id").join(passed, "user_id", "left")
    cards = first_cards(asked.select("user_id", "pool_id", (F.col("_t") + F.coalesce("_n", F.lit(0))).alias("upto")), laid, ["pool_id"])
    return visible(cards.drop("upto", "place"), seen)


def family_claims(follows: DataFrame, pools: DataFrame, seen: DataFrame) -> DataFrame:
    """Pages of a family, filled in order: ``user_id, family, page_pos, work_id, slot``.

    Every page shows its unseen primaries (rank up to ``target``). Where a user has seen
    some, reserves take their places: unseen, eligible, in order of rank, and neither a
    primary that the family shows nor claimed by an earlier page. ``follows`` has
    ``user_id, family``, ``pools`` a row per ``family, page_pos, work_id`` with ``rank,
    target, eligible``, ``seen`` ``user_id, work_id``. Null keys join nothing.

    What all followers of a family have in common is made once: the places of primaries,
    and the reserves that are no primary of the family (an unseen one is shown, so that
    none of them can be claimed). Users bring only what they have seen of it. A page
    passes over one reserve at most for each one of its own that the user has seen or that
    an earlier page claimed: its need plus these counts bounds what it can use, and no
    more than that of its reserves is joined. What a page may use depends on those before
    it, so the pages of a user's family, so bounded, are folded in one array.
    """
    page = ["user_id", "family", "page_pos"]
    follows, seen = follows.select("user_id", "family").distinct(), seen.select("user_id", "work_id").where("user_id IS NOT NULL AND work_id IS NOT NULL").distinct()
    own = pools.join(small(staged(follows.select("family").distinct(), "families")), "family", "left_semi")
    in_order = Window.partitionBy("family", "page_pos").orderBy("rank", "work_id")
    primary = staged(own.where("rank <= target").withColumn("place", F.row_number().over(in_order)).select("family", "page_pos", "work_id", "target", "place"), "primaries")
    laid = own.where("rank > target AND eligible AND work_id IS NOT NULL").join(small(primary.select("family", "work_id").distinct()), ["family", "work_id"], "left_anti")
    laid = staged(laid.withColumn("place", F.row_number().over(in_order)).select("family", "page_pos", "work_id", "place"), "reserves")
    hits = seen.join(primary, "work_id").join(follows, ["user_id", "family"], "left_semi").select(*page, "place")
    mine = follows.join(hits.groupBy("user_id", "family").agg(F.collect_list(F.struct("page_pos", "place")).alias("hits")), ["user_id", "family"], "left").join(primary, "family")
    here = lambda h: h["page_pos"] == F.col("page_pos")
    gone = F.coalesce(F.exists("hits", lambda h: here(h) & (h["place"] == F.col("place"))), F.lit(False))
    before = F.size(F.filter("hits", lambda h: here(h) & (h["place"] < F.col("place"))))
    shown = mine.where(~gone).withColumn("slot", F.when(F.col("hits").isNull(), F.col("place")).otherwise(F.col("place") - before)).select(*page, "work_id", "slot")
    pages = primary.groupBy("family", "page_pos").agg(F.max("target").alias("target"), F.count("*").alias("n"))
    # pages with fewer primaries than their target are short for all who follow them
    lacking = follows.join(pages.where("n < target").select("family", "page_pos"), "family").select(*page, F.lit(0).alias("hit"))
    short = hits.select(*page, F.lit(1).alias("hit")).unionByName(lacking).groupBy(*page).agg(F.sum("hit").alias("hit")).join(pages, ["family", "page_pos"])
    short = short.select(*page, (F.col("target") - F.col("n") + F.col("hit")).alias("need"), (F.col("n") - F.col("hit")).alias("visible")).where("need > 0")
    earlier = Window.partitionBy("user_id", "family").orderBy("page_pos").rowsBetween(Window.unboundedPreceding, -1)
    passed = seen.join(laid, "work_id").groupBy(*page).agg(F.count("*").alias("_seen"))
    asked = short.withColumn("_claimed", F.coalesce(F.sum("need").over(earlier), F.lit(0))).join(passed, page, "left")
    asked = asked.select(*page, "need", "visible", (F.col("need") + F.col("_claimed") + F.coalesce("_seen", F.lit(0))).alias("upto"))
    cards = first_cards(asked, laid, ["family", "page_pos"])
    cards = cards.join(seen, ["user_id", "work_id"], "left_anti")
    offers = cards.groupBy(*page).agg(F.max("need").alias("need"), F.max("visible").alias("visible"), F.transform(F.sort_array(F.collect_list(F.struct("place", "work_id"))), lambda c: c["work_id"]).alias("works"))
    family = offers.groupBy("user_id", "family").agg(F.sort_array(F.collect_list(F.struct("page_pos", "need", "visible", "works"))).alias("pages"))
    kind = {c: t for c, t in pools.dtypes}
    none = F.struct(F.array().cast(f"array<{kind['work_id']}>").alias("claimed"), F.array().cast(f"array<struct<page_pos:{kind['page_pos']},work_id:{kind['work_id']},slot:int>>").alias("out"))

    def fill(so_far: Column, p: Column) -> Column:
        took = F.slice(F.filter(p["works"], lambda w: ~F.array_contains(so_far["claimed"], w)), F.lit(1), p["need"].cast("int"))
        placed = F.transform(took, lambda w, i: F.struct(p["page_pos"].alias("page_pos"), w.alias("work_id"), (p["visible"] + i + 1).cast("int").alias("slot")))
        return F.struct(F.concat(so_far["claimed"], took).alias("claimed"), F.concat(so_far["out"], placed).alias("out"))

    taken = family.select("user_id", "family", F.explode(F.aggregate("pages", none, fill)["out"]).alias("r")).select("user_id", "family", "r.*")
    return shown.unionByName(taken)


def seen_status(events: DataFrame) -> DataFrame:
    """T02, batch: ``user_id, k, seen, status, previous_status`` after all actions of a user on a key, in the order of ``ts, event_id``.

    An action is seen, unseen, toggle, or a status that the user sets. What is seen has
    the status ``vu`` and remembers the one set last, which unseen restores (null: none).
    The last action that isn't a toggle, and the parity of the toggles after it, tell
    whether a key is seen: two counts, no replay.
    """
    own = ["user_id", "k"]
    e = events.select(*own, "action", F.struct("ts", "event_id").alias("at"))
    said, chosen = F.col("action") != "toggle", ~F.col("action").isin("seen", "unseen", "toggle")
    last = e.groupBy(*own).agg(F.max(F.when(said, F.struct("at", "action"))).alias("last"), F.max(F.when(chosen, F.struct("at", "action"))).alias("chosen"))
    toggles = e.where(~said).join(last.select(*own, F.col("last.at").alias("since")), own).where("since IS NULL OR at > since").groupBy(*own).agg(F.count("*").alias("toggles"))
    j = last.join(toggles, own, "left")
    seen = F.coalesce(F.col("last.action") == "seen", F.lit(False)) != (F.coalesce("toggles", F.lit(0)) % 2 == 1)
    status = F.col("chosen.action")
    return j.select(*own, seen.alias("seen"), F.when(seen, "vu").otherwise(status).alias("status"), F.when(seen, status).alias("previous_status"))


def latest_topic(topics: DataFrame) -> DataFrame:
    """The newest row per topic; rows without a time last."""
    w = Window.partitionBy("topic_id").orderBy(F.desc_nulls_last("activity_at"), F.desc("row_id"))
    return topics.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
