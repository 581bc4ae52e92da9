"""Structured Streaming jobs."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.functions.keys import fresh_key
from gridloom.functions.parse import release_title


def guarded(events: DataFrame, now: str | None, hours: int, time: str = "activity_at") -> DataFrame:
    """The watermark drops what is later than ``hours``; rows more than ten minutes ahead of the clock are refused."""
    clock = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return events.withWatermark(time, f"{hours} hours").where(F.col(time) <= clock + F.expr("INTERVAL 10 MINUTES"))


def kept_for(events: DataFrame, hours: int) -> DataFrame:
    """The newest row of each key, remembered for as long as it can matter.

    ``events`` has ``k, at, value, found`` and a watermark on ``at``. A row is emitted
    where it is newer than what the state holds of its key; of equal times a find, then
    the greatest value, wins. A row that finds nothing is emitted and clears the state
    of its key. State goes once the watermark is ``hours`` past its row. `current` tells
    what of the emitted rows holds at an instant.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # null values sort as empty ones
        rows = ((r.at_us, r.found, r.value or "", r.value) for frame in frames for r in frame.itertuples())
        at_us, found, _, value = max(rows, key=lambda r: r[:3])
        if state.exists and state.get >= (at_us, value or ""):
            state.setTimeoutTimestamp(max(state.get[0] // 1000 + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
            return
        ends = at_us // 1000 + hours * 3_600_000
        if found and ends > state.getCurrentWatermarkMs():
            state.update((at_us, value or ""))
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"k": [key[0]], "at_us": [at_us], "value": [value], "found": [found]})

    rows = events.select("k", "at", F.unix_micros("at").alias("at_us"), "value", "found")
    out = rows.groupBy("k").applyInPandasWithState(step, "k string, at_us long, value string, found boolean", "at_us long, value string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("k", F.timestamp_micros("at_us").alias("at"), "value", "found")


def current(emitted: DataFrame, now: Column, hours: int) -> DataFrame:
    """Of rows that `kept_for` emitted, or of its input, the newest of each key, if it found something and is no older than ``hours`` at ``now``."""
    newest = emitted.where(F.col("at") <= now + F.expr("INTERVAL 10 MINUTES")).groupBy("k").agg(F.max(F.struct("at", "found", "value")).alias("r")).select("k", "r.*")
    return newest.where(F.col("found") & (F.col("at") >= now - F.make_dt_interval(hours=F.lit(hours)))).select("k", "at", "value")


def recent_topics(events: DataFrame, hours: int = 24, now: str | None = None) -> DataFrame:
    """The latest activity of each topic, emitted as it comes. `current` cuts at ``hours`` before any instant; state goes by age."""
    e = guarded(events, now, hours)
    return kept_for(e.select(F.col("topic_id").cast("string").alias("k"), F.col("activity_at").alias("at"), F.col("title").alias("value"), F.lit(True).alias("found")), hours)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A40 as a stream: work sessions per user with their events and span."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def seen_state(events: DataFrame, late: str = "1 hour", buckets: int = 8192) -> DataFrame:
    """The status of each key of a user after each of its actions, in the order of their times.

    ``events`` has ``user_id, k, ts, event_id, action``: seen, unseen, toggle, or a status
    that the user sets. Seen remembers the status, unseen restores it (null where there
    was none). Rows wait in the state until the watermark, ``late`` behind the newest, has
    passed them: within that, late and shuffled rows give what a replay in order gives.
    ``personal.seen_status`` is the batch form.

    A call from Spark costs far more than a row, so users share a state by the hash of
    their id, in ``buckets``, which stay the same for the life of a checkpoint. A state is
    JSON text: nested rows take a multiple of the time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, rows = map(json.loads, state.get) if state.exists else ([], [])
        now = {(user, k): (on, status) for user, k, on, status in held}
        for f in frames:
            rows += zip(*(f[c].tolist() for c in ("ts_us", "event_id", "user", "k", "action")))
        rows.sort(key=lambda w: (w[0], w[1]))
        done = bisect_left(rows, state.getCurrentWatermarkMs() * 1000, key=lambda w: w[0])
        out = []
        for ts_us, event_id, user, k, action in rows[:done]:
            on, status = now.get((user, k), (False, None))
            if action in ("seen", "unseen", "toggle"):
                on = not on if action == "toggle" else action == "seen"
            else:
                on, status = False, action
            now[user, k] = (on, status)
            out.append((None if user is None else int(user), k, ts_us, event_id, "vu" if on else status, status if on else None))
        waiting = rows[done:]
        state.update((json.dumps([(*at, *s) for at, s in now.items()]), json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "k", "ts_us", "event_id", "status", "previous_status"])

    # ids go as text: a column of numbers with a null would come as floats
    rows = events.withWatermark("ts", late).select(F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"), F.col("user_id").cast("string").alias("user"), "k", "ts", F.unix_micros("ts").alias("ts_us"), "event_id", "action")
    return rows.groupBy("bucket").applyInPandasWithState(step, "user_id long, k string, ts_us long, event_id long, status string, previous_status string", "held string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def capture_ages(captures: DataFrame, ttl_hours: int, stale_hours: int, late: str = "1 hour") -> DataFrame:
    """The states that each source goes through, ``source_key, at, state``: fresh, expired, stale or failed.

    ``captures`` has ``source_key, fetched_at, capture_id, ok``. A good capture makes its
    source fresh. After ``ttl_hours`` it is expired, after ``stale_hours`` stale, unless a
    newer one comes before; a refresh that fails makes what is there stale at once, and
    a source without any capture failed. Captures count in the order of their times and
    wait for the watermark, ``late`` behind the newest; a timer lets the clock do the
    rest. A transition is emitted once the watermark has passed it.
    """
    hour = 3_600_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], timer: GroupState) -> Iterator[pd.DataFrame]:
        state, fetched, waiting = timer.get if timer.exists else (None, 0, [])
        waiting = [tuple(w) for w in waiting] + [(r.at_us, r.capture_id, r.ok) for f in frames for r in f.itertuples()]
        waiting.sort(key=lambda w: w[:2])
        passed, out = timer.getCurrentWatermarkMs() * 1000, []

        def due() -> int | None:
            """When the clock alone changes the state next."""
            return {"fresh": fetched + ttl_hours * hour, "expired": fetched + stale_hours * hour}.get(state)

        while True:
            clock, row = due(), waiting[0] if waiting else None
            # what happens at one instant: first the clock, then captures
            at = min(x for x in (clock, row and row[0], passed) if x is not None)
            if at >= passed:
                break
            if clock is not None and clock == at:
                state = "expired" if state == "fresh" else "stale"
            else:
                waiting.pop(0)
                new = "fresh" if row[2] else "failed" if state in (None, "failed") else "stale"
                fetched = at if row[2] else fetched
                if new == state != "fresh":
                    continue
                state = new
            out.append((*key, at, state))
        timer.update((state, fetched, waiting))
        ahead = [x for x in (due(), waiting[0][0] if waiting else None) if x is not None]
        if ahead:
            timer.setTimeoutTimestamp(max(min(ahead) // 1000 + 1, timer.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["source_key", "at_us", "state"])

    rows = captures.withWatermark("fetched_at", late).select("source_key", "fetched_at", F.unix_micros("fetched_at").alias("at_us"), "capture_id", "ok")
    held = "state string, fetched long, waiting array<struct<at_us:bigint,capture_id:bigint,ok:boolean>>"
    out = rows.groupBy("source_key").applyInPandasWithState(step, "source_key string, at_us long, state string", held, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("source_key", F.timestamp_micros("at_us").alias("at"), "state")


def match_cache(matches: DataFrame, hours: int = 7 * 24, late: str = "1 hour") -> DataFrame:
    """The newest match of each key, for ``hours`` by its age; a search without a match clears its key, and absence is never kept."""
    m = matches.withWatermark("ts", late)
    return kept_for(m.select(F.col("k").cast("string").alias("k"), F.col("ts").alias("at"), F.col("match_id").cast("string").alias("value"), "found"), hours)


def enrich(topics: DataFrame, works: DataFrame) -> DataFrame:
    """Topics parsed, matched to the catalogue by title key and year, and filled from it (stream–static join)."""
    if topics.isStreaming:
        t = topics.withColumn("r", release_title(F.col("topic_title")))
    else:  # titles recur: each is parsed once, and a topic may match many works, so that topics are dealt over all partitions
        parsed = topics.select(F.col("topic_title").alias("_title")).distinct().withColumn("r", release_title(F.col("_title")))
        dealt = topics.repartition(int(topics.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        t = dealt.join(parsed, F.col("topic_title").eqNullSafe(F.col("_title")), "left").drop("_title")
    t = t.withColumn("_k", fresh_key(F.col("r.title"))).withColumn("_y", F.col("r.year"))
    # a work stands under its year and, for topics without one, under none, so that the year is a key of the join
    years = F.explode(F.array_distinct(F.array(F.col("year"), F.lit(None))))
    cat = works.select(fresh_key(F.col("title")).alias("_ck"), years.alias("_cy"), F.col("id").alias("work_id"), F.col("director").alias("catalogue_director"))
    j = t.join(cat, (F.col("_k") == F.col("_ck")) & F.col("_y").eqNullSafe(F.col("_cy")), "left")
    return j.select(*[c for c in topics.columns], F.col("r.title").alias("title"), F.col("_y").alias("year"), F.coalesce("r.director", "catalogue_director").alias("director"), "work_id")
