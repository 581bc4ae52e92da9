"""Candidate planning: groups, classification, queues, tasks and guide groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.staging import Scratch, staged


def classify(groups: DataFrame) -> DataFrame:
    """Paused, conflicted, materialised, reusable or new; and the requirements that are open.

    ``groups`` has one row per work and day: ``paused, conflict, has_card, prior_weeks,
    has_work`` and a boolean ``has_<fact>`` for image, rating, summary and evidence.
    """
    kind = F.when(F.col("paused"), "paused").when(F.col("conflict"), "conflicted").when(F.col("has_card"), "materialised").when(F.col("has_work") & (F.col("prior_weeks") > 0), "reusable").otherwise("new")
    need = F.array_compact(F.array(*[F.when(~F.col(f"has_{x}"), F.lit(x)) for x in ("work", "image", "rating", "summary", "evidence")]))
    return groups.withColumn("classification", kind).withColumn("requirements", F.array_join(need, ","))


def scope_deficits(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required, present and missing per day and section."""
    n = present.groupBy("date", "section").agg(F.countDistinct("work_id").alias("present"))
    out = required.join(n, ["date", "section"], "left").withColumn("present", F.coalesce("present", F.lit(0)))
    return out.withColumn("deficit", F.greatest(F.lit(0), F.col("target") - F.col("present")))


def status_matrix(rows: DataFrame, scope: str, status: str, statuses: list[str]) -> DataFrame:
    """Counts of every status per scope, zeros included."""
    return rows.groupBy(scope).pivot(status, statuses).count().na.fill(0, statuses)


#: Weekdays, Saturday first, as messages name them.
WEEKDAYS = ("samedi", "dimanche", "lundi", "mardi", "mercredi", "jeudi", "vendredi")
_DAY = "|".join(WEEKDAYS)
#: Fixed values of A32: pattern of a message, then id, title and kind of the action that it asks for; {} is the day that the pattern finds.
ACTIONS = (
    (r"(?i)^coverage full_week_reaudit_completed must be true$|^Full inventory-first coverage audit not completed$", "coverage-full-week", "Achever et attester la revue des sept jours", "coverage"),
    (rf"(?i)^({_DAY})(?:-selection: \d+ candidats \(< \d+\) et shortage_reason non structuré| reserve too shallow without shortage_reason)$", "daily-reserve-{}", "Compléter les réserves de {} ou documenter une pénurie réelle", "day"),
    (r"(?i)^Popularity radar reserve duplicates scan or public primary: ", "radar-popularity-overlap", "Réconcilier les réserves et la sélection du radar de popularité", "radar"),
    (r"(?i)^Popularity radar (?:distinct )?reserve too shallow$", "radar-popularity-depth", "Compléter les réserves distinctes du radar de popularité", "radar"),
)
#: Fixed values of A33: words of messages about coverage, and about deliverables.
COVERAGE = "inventory|inventaire|coverage|couverture|channels|chaînes|reaudit|cross-check|source_pages|overnight"
DELIVERABLES = "radar|hero|toc|sommaire|artifact missing|manifest|shell|coquille"
#: Fixed value of A33: a summary line of a validator, which is no problem of its own.
SUMMARY = r"(?i)gate failed: \d+ problem|readiness: \d+ problème"


def task_board(gaps: DataFrame, rules: tuple[tuple[str, str, str, str], ...] = ACTIONS) -> DataFrame:
    """Messages by the action that they ask for: ``action, title, kind, blocking, n``.

    ``gaps`` has ``pos, message, severity`` and may have ``scope``. The first rule whose
    pattern a message fits names its action. A message that fits none is an action of its
    own, ``observation-<pos>``: two like phrases need not have one cause. An action blocks
    if any of its messages does. Null messages count as empty.
    """
    message = F.coalesce("message", F.lit(""))
    scope = F.coalesce("scope", F.lit("global")) if "scope" in gaps.columns else F.lit("global")
    action = F.struct(F.concat(F.lit("observation-"), F.col("pos").cast("string")).alias("action"), message.alias("title"), scope.alias("kind"))
    for pattern, name, title, kind in reversed(rules):
        found = F.lower(F.regexp_extract(message, pattern, 1)) if "{}" in name else F.lit("")
        put = lambda text, found=found: F.replace(F.lit(text), F.lit("{}"), found)
        action = F.when(message.rlike(pattern), F.struct(put(name).alias("action"), put(title).alias("title"), F.lit(kind).alias("kind"))).otherwise(action)
    acted = gaps.select(action.alias("a"), "severity").select("a.*", "severity")
    return acted.groupBy("action", "title", "kind").agg(F.bool_or(F.col("severity") == "blocking").alias("blocking"), F.count("*").alias("n"))


def problem_lines(outputs: DataFrame, output: str = "output") -> DataFrame:
    """The problems in what validators print, a row each: ``severity`` (✗ blocking, ! warning) and ``message``, with ``line``; summary lines are none."""
    lines = outputs.select(*[c for c in outputs.columns if c != output], F.posexplode(F.split(output, r"\r?\n")).alias("line", "_text")).withColumn("_text", F.trim("_text"))
    kept = lines.where(F.col("_text").rlike("^[✗!]") & ~F.col("_text").rlike(SUMMARY))
    return kept.withColumn("severity", F.when(F.startswith("_text", F.lit("✗")), "blocking").otherwise("warning")).withColumn("message", F.regexp_replace("_text", r"^[✗!]\s*", "")).drop("_text")


def gap_scope(message: Column, first: Column, sections: list[str]) -> Column:
    """``struct(kind, value)``: what a message is about: coverage (with the day), a section, a day, a deliverable, or all.

    A day is named, or is a date of the seven from ``first``. Of the section ids the
    first that occurs counts; those that end in ``-selection`` are days' own.
    """
    m = F.lower(F.coalesce(message, F.lit("")))
    dated = F.coalesce(*[F.when(F.contains(m, F.date_add(first, i).cast("string")), F.lit(d)) for i, d in enumerate(WEEKDAYS)])
    day = F.coalesce(*[F.when(m.rlike(rf"\b{d}\b"), F.lit(d)) for d in WEEKDAYS], dated)
    section = F.coalesce(*[F.when(F.contains(m, F.lit(s.lower())), F.lit(s)) for s in sections], F.lit(None).cast("string"))
    scope = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    none = F.lit(None).cast("string")
    return (
        F.when(m.rlike(COVERAGE), scope("coverage", day)).when(section.isNotNull() & ~F.endswith(section, F.lit("-selection")), scope("rubrique", section))
        .when(day.isNotNull(), scope("day", day)).when(m.rlike(DELIVERABLES), scope("deliverable", none)).otherwise(scope("global", none))
    )


def gap_totals(gaps: DataFrame, first: Column, sections: list[str]) -> DataFrame:
    """Messages per scope (``kind`` or ``kind:value``) and severity."""
    scoped = gaps.select(gap_scope(F.col("message"), first, sections).alias("s"), "severity")
    return scoped.groupBy(F.concat_ws(":", "s.kind", "s.value").alias("scope"), "severity").agg(F.count("*").alias("n"))


def linked(edges: DataFrame, tmp: Scratch) -> DataFrame:
    """``node, label`` of the connected components of ``u, v``: the smallest node of each.

    A round takes the smallest label around a node and then that label's own; rounds go
    on until none changes, so that a chain of n takes about log n. Each round is staged
    in ``tmp``.
    """
    both = tmp.staged(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    cur = tmp.staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        around = both.join(cur, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("m"))
        low = cur.join(around, F.col("node") == F.col("u")).select("node", F.col("label").alias("before"), F.least("label", "m").alias("label"))
        jump = cur.select(F.col("node").alias("_at"), F.col("label").alias("_to"))
        new = tmp.staged(low.join(jump, F.col("label") == F.col("_at")).select("node", F.col("_to").alias("label"), (F.col("_to") != F.col("before")).alias("moved")), "labels")
        tmp.drop(cur)
        cur = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return cur


def guide_groups(reports: DataFrame) -> DataFrame:
    """Independent groups of guides per slot, ``slot, n_groups, official, routes``.

    ``reports`` has ``slot, publisher, feed, evidence, official``. Publishers are the
    same whatever their case; those that share a feed are one group where there is
    evidence of it, through as many others as it takes. Official sources are in no group;
    a guide without a publisher is none. Routes: official (one such source),
    concordant (two groups).
    """
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    r = reports.select("slot", F.lower(text("publisher")).alias("publisher"), F.when(text("evidence").isNotNull(), text("feed")).alias("feed"), F.coalesce("official", F.lit(False)).alias("official"))
    with Scratch(reports.sparkSession, "guides") as tmp:
        guides = r.where("NOT official AND publisher IS NOT NULL")
        node = lambda kind, c: F.struct("slot", F.lit(kind).alias("kind"), F.col(c).alias("name"))
        edges = guides.where("feed IS NOT NULL").select(node("publisher", "publisher").alias("u"), node("feed", "feed").alias("v"))
        label = linked(edges, tmp).where("node.kind = 'publisher'").select(F.col("node.slot").alias("_slot"), F.col("node.name").alias("_publisher"), "label")
        grouped = guides.select("slot", "publisher").distinct().join(label, (F.col("slot") == F.col("_slot")) & (F.col("publisher") == F.col("_publisher")), "left")
        n = grouped.groupBy("slot").agg(F.countDistinct(F.coalesce("label", node("publisher", "publisher"))).alias("n_groups"))
        out = r.groupBy("slot").agg(F.bool_or("official").alias("official")).join(n, "slot", "left").na.fill(0, ["n_groups"])
        routes = F.concat_ws(",", F.when(F.col("official"), "official"), F.when(F.col("n_groups") >= 2, "concordant"))
        return staged(out.select("slot", "n_groups", "official", routes.alias("routes")), "guide-groups")


def overview(signals: DataFrame) -> DataFrame:
    """Per printed title best mark, number of slots, latest date and catalogue id, with the place in order of score."""
    g = signals.groupBy("title_key").agg(F.max("score").alias("best"), F.countDistinct("date", "start_min", "channel").alias("slots"), F.max("date").alias("latest"), F.min("work_id").alias("work_id"))
    return g


def leads(titles: DataFrame, index: DataFrame, exposure: DataFrame) -> DataFrame:
    """Titles with their matches, counts and how many weeks they were exposed before."""
    seen = exposure.groupBy("title_key").agg(F.countDistinct("week").alias("weeks"))
    n = titles.groupBy("title_key").agg(F.count("*").alias("n"))
    return n.join(index.select("title_key", "n_matches"), "title_key", "left").join(seen, "title_key", "left").select("title_key", "n", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("weeks", F.lit(0)).alias("weeks"))


def evidence_packet(titles: DataFrame, slots: DataFrame, records: DataFrame, exposure: DataFrame) -> DataFrame:
    """What is known of given titles: sorted slots, record fields and exposed weeks, each list aggregated before the join."""
    text = lambda df, c, name: df.groupBy("title_key").agg(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(name))
    out = titles.select("title_key").distinct()
    for df in (text(slots, "slot", "slots"), text(records, "field", "fields"), text(exposure, "week", "weeks")):
        out = out.join(df, "title_key", "left")
    return out.na.fill("", ["slots", "fields", "weeks"])


def coverage_flags(days: DataFrame) -> DataFrame:
    """Per title the days covered and its sorted statuses."""
    return days.groupBy("title_key").agg(F.sum(F.col("covered").cast("long")).alias("covered"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"))


def phase_spans(log: DataFrame) -> DataFrame:
    """Start, end, seconds and order check per session and phase."""
    g = log.groupBy("session", "phase").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    prev = F.max("end").over(Window.partitionBy("session").orderBy("start", "phase").rowsBetween(Window.unboundedPreceding, -1))
    return g.withColumn("seconds", F.unix_timestamp("end") - F.unix_timestamp("start")).withColumn("overlaps", F.coalesce(F.col("start") < prev, F.lit(False)))


def initial_seeds(signals: DataFrame, groups: DataFrame, least: int = 2) -> DataFrame:
    """Signals with a mark of ``least`` or more that match exactly one open group are seeds; the others say why they are preserved. Groups are counted per title and day before they meet the signals."""
    open_ = groups.where("open").groupBy("title_key", "date").agg(F.min("group_id").alias("group_id"), F.countDistinct("group_id").alias("n"))
    out = signals.join(open_, ["title_key", "date"], "left").na.fill(0, ["n"])
    reason = F.when(F.col("score") < least, "low_mark").when(F.col("n") == 0, "no_group").when(F.col("n") > 1, "several_groups")
    return out.withColumn("reason", reason).withColumn("group_id", F.when(reason.isNull(), F.col("group_id")))


def shortlist(entries: DataFrame, signals: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each card with its best sourced signal (priority, then id), and compact records distinct by work, field, URL and scope."""
    best = signals.withColumn("_r", F.row_number().over(Window.partitionBy("card_id").orderBy("priority", "signal_id"))).where("_r = 1").drop("_r")
    return entries.join(best, "card_id", "left"), records.dropDuplicates(["work_id", "field", "url", "scope"])


def day_ranks(rows: DataFrame) -> DataFrame:
    """Ranks that restart per day: explicit rank first, else primaries, then reserves, stable."""
    w = Window.partitionBy("date").orderBy(F.coalesce("rank", F.lit(1_000_000)), (~F.col("primary")).cast("int"), "pos")
    return rows.withColumn("new_rank", F.row_number().over(w))


def rank_errors(rows: DataFrame) -> DataFrame:
    """Rows of a pool whose rank is not an integer from 1 or not unique."""
    n = F.count("*").over(Window.partitionBy("pool_id", "rank"))
    return rows.withColumn("_n", n).where("rank IS NULL OR rank < 1 OR _n > 1").drop("_n")


def append_contract(existing: DataFrame, new: DataFrame) -> DataFrame:
    """per pool whether ranks are contiguous, the new works are new, and the new ranks continue the tail."""
    e = existing.groupBy("pool_id").agg(F.max("rank").alias("tail"), (F.max("rank") == F.count("*")).alias("contiguous"))
    known = new.join(existing.select("pool_id", "work_id"), ["pool_id", "work_id"], "left_semi").groupBy("pool_id").agg(F.count("*").alias("known"))
    n = new.groupBy("pool_id").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count("*").alias("n"))
    out = e.join(n, "pool_id").join(known, "pool_id", "left")
    return out.select("pool_id", "contiguous", F.coalesce("known", F.lit(0)).alias("known_works"), ((F.col("lo") == F.col("tail") + 1) & (F.col("hi") == F.col("tail") + F.col("n"))).alias("continues"))


def priority_queue(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows with their place in the order of the keys. The order is global: Spark sorts by range, and the place is counted per sorted partition.

    Places come from the sizes of the sorted partitions, so that no task holds the
    whole queue. The sorted rows are staged: their range bounds are sampled, and both
    readers must see the same ones.
    """
    ordered = rows.orderBy(*keys).withColumn("_m", F.monotonically_increasing_id())
    ordered = staged(ordered.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))), "queue")
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.select(F.col("_p"), F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return ordered.join(F.broadcast(before), "_p").withColumn("place", F.col("_b") + F.col("_i") + 1).drop("_m", "_p", "_i", "_b")  # one row a partition


def page_of(queue: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of a queue with places, and ``next_offset`` (null on the last page)."""
    total = queue.agg(F.max("place").alias("_t"))
    out = queue.where((F.col("place") > offset) & (F.col("place") <= offset + limit)).crossJoin(F.broadcast(total))  # one row
    return out.withColumn("next_offset", F.when(F.col("_t") > offset + limit, offset + limit)).drop("_t")
