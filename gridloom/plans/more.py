"""Further registered queries: audits, ladders, planning and projections. Names begin with the operators they apply."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import parse, predicates
from gridloom.functions.calendar import FRENCH_MONTHS, issue_from, week_of_saturday
from gridloom.operators import audits, consensus, identity, personal, planning, readers, schedule
from gridloom.plans.frames import LINKS, OCC, POOL, SCHED, WORKS, line_links, occurrences, pool, table, works
from gridloom.plans.frames import schedule as programme
from gridloom.plans.queries import KEY, big, query


@query("f23_calendar_audit", """WITH i AS (SELECT date_trunc('month', CAST(o_orderdate AS DATE))::DATE AS month, min(CAST(o_orderdate AS DATE)) AS "from", max(CAST(o_orderdate AS DATE)) AS last, min(o_orderkey) AS k FROM orders WHERE day(o_orderdate) BETWEEN 4 AND 12 GROUP BY 1),
w AS (SELECT 'w' || strftime(month, '%Y-%m') AS label, "from", CASE WHEN k % 2 = 0 THEN "from" + 6 ELSE last END AS "to", strftime("from" + CAST((5 - (isodow("from") - 1)) % 7 AS INTEGER) + 2, '%G-S%V') AS near, strftime("from" + 2, '%G-S%V') AS own FROM i),
p AS (SELECT CASE WHEN month(CAST("from" AS DATE)) % 3 = 0 THEN label ELSE own END AS week, own, "from", "to", "from" - lag("from") OVER (ORDER BY "from") AS d FROM w)
SELECT week, week = own AS id_ok, isodow("from") = 6 AND "to" - "from" = 6 AS span_ok, coalesce(d > 0, true) AS advances, CAST(coalesce(greatest(0, d // 7 - 1), 0) AS BIGINT) AS skipped FROM p""")
def f23(spark, d):
    """An issue a month, from the first order date after the third to six days on or the last before the thirteenth: few begin on a Saturday and end on a Friday, some bear another id."""
    day = F.col("o_orderdate").cast("date")
    i = table(spark, d, "orders").where(F.dayofmonth(day).between(4, 12)).groupBy(F.trunc(day, "month").alias("month")).agg(F.min(day).alias("from"), F.max(day).alias("last"), F.min("o_orderkey").alias("k"))
    named = F.when(F.month("from") % 3 == 0, F.concat(F.lit("w"), F.date_format("month", "yyyy-MM"))).otherwise(week_of_saturday(F.col("from")))
    i = i.select(named.alias("week"), "from", F.when(F.col("k") % 2 == 0, F.date_add("from", 6)).otherwise(F.col("last")).alias("to"))
    return audits.calendar_audit(i).withColumn("skipped", big("skipped"))


@query("f26_manifest_audit", f"""WITH {OCC}, m AS (SELECT strftime(CAST(o_orderdate AS DATE) - CAST((isodow(o_orderdate) + 1) % 7 AS INTEGER) + 2, '%G-S%V') AS week, count(DISTINCT o_custkey) % 5 + 20 AS declared FROM orders GROUP BY 1), c AS (SELECT week, pool_id % 25 AS page_id, count(*) AS cards FROM occ GROUP BY ALL), p AS (SELECT week, count(DISTINCT page_id) AS actual, max(cards) AS most FROM c GROUP BY week),
j AS (SELECT week, declared, actual, most FROM m FULL JOIN p USING (week))
SELECT week, 'not_in_manifest' AS problem FROM j WHERE declared IS NULL UNION ALL SELECT week, 'no_issue' FROM j WHERE actual IS NULL UNION ALL SELECT week, 'page_count' FROM j WHERE declared <> actual UNION ALL SELECT week, 'too_many_cards' FROM j WHERE most > 12""")
def f26(spark, d):
    occ = occurrences(spark, d)
    m = table(spark, d, "orders").groupBy(week_of_saturday(issue_from(F.col("o_orderdate").cast("date"))).alias("week")).agg((F.countDistinct("o_custkey") % 5 + 20).alias("page_count"))
    p = occ.groupBy("week", (F.col("pool_id") % 25).alias("page_id")).agg(F.count("*").alias("cards"))
    return audits.manifest_audit(m, p, 12)


@query("a14_readiness", f"""WITH {POOL} SELECT pool_id, count(*) AS n, CAST(sum(CASE WHEN work_id % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_ready, CAST(sum(CASE WHEN rank > target AND work_id % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS ready_reserves, CAST(grouping(pool_id) AS BIGINT) AS all_pools FROM pool GROUP BY ROLLUP (pool_id)""")
def a14(spark, d):
    return audits.readiness(pool(spark, d), F.col("work_id") % 3 != 0).withColumn("all_pools", big("all_pools"))


@query("a14_problem_list", f"""WITH {POOL}, c AS (SELECT pool_id, work_id, rank, unnest([CASE WHEN p_size > 40 THEN 'year' END, CASE WHEN p_brand IS NULL OR p_brand = 'Brand#1' THEN 'director' END, CASE WHEN p_retailprice < 1000 THEN 'rating' END, CASE WHEN p_partkey IS NULL THEN 'work' END]) AS problem
FROM pool LEFT JOIN (SELECT * FROM part WHERE p_size <> 7) ON p_partkey = work_id) SELECT pool_id, work_id, rank, problem FROM c WHERE problem IS NOT NULL UNION ALL
SELECT pool_id, work_id, rank, unnest(['year', 'rating']) FROM pool WHERE work_id IN (SELECT p_partkey FROM part WHERE p_size = 7)""")
def a14_problems(spark, d):
    """Candidates with the facts of their part; what isn't known counts as lacking, and some parts are in no catalogue."""
    works_ = table(spark, d, "part").where("p_size <> 7").select(F.col("p_partkey").alias("id"), "p_size", "p_brand", "p_retailprice")
    j = pool(spark, d).join(works_, F.col("work_id") == F.col("id"), "left")
    checks = {"work": F.col("id").isNotNull(), "year": F.col("p_size") <= 40, "director": F.col("p_brand") != "Brand#1", "rating": F.col("p_retailprice") >= 1000}
    return audits.candidate_problems(j, checks).withColumn("rank", big("rank"))


@query("a39_pool_summary", f"""WITH {POOL}, q AS (SELECT * FROM pool WHERE NOT (pool_id % 5 = 0 AND rank = 2)) SELECT q.pool_id, count(*) AS n, min(rank) = 1 AND max(rank) = count(*) AS ranks_ok, CAST(CASE WHEN q.pool_id % 5 = 0 THEN (SELECT count(*) FROM pool p WHERE p.pool_id = q.pool_id AND p.rank = 2) ELSE 0 END AS BIGINT) AS missing_primaries FROM q GROUP BY q.pool_id""")
def a39(spark, d):
    p = pool(spark, d)
    return audits.pool_summary(p.where("NOT (pool_id % 5 = 0 AND rank = 2)"), p.where("rank <= target"))


@query("f12_host_diversity", r"""WITH p AS (SELECT page_id % 60 AS date, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host, page_id % 7 = 0 AS document FROM pages) SELECT date, count(DISTINCT host) AS hosts FROM p GROUP BY date HAVING count(DISTINCT host) < 8 AND NOT bool_or(document)""")
def f12(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 60).alias("date"), parse.url_host(F.col("url")).alias("host"), (F.col("page_id") % 7 == 0).alias("document"))
    return audits.host_diversity(p, 8)


@query("p22_country_names", "SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 'Royaume-Uni' WHEN c_nationkey < 20 THEN 'Pays ' || CAST(c_nationkey AS VARCHAR) ELSE c_name END AS country_fr FROM customer")
def p22(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("iso"), F.col("c_name").alias("name"))
    n = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("iso"), F.concat(F.lit("Pays "), F.col("n_nationkey").cast("string")).alias("name_fr"))
    return audits.country_names(c, n, {"0": "Royaume-Uni"}).select("c_custkey", "country_fr")


@query("w16_signal_order", f"WITH {SCHED} SELECT row_id AS signal_id, row_number() OVER (PARTITION BY date ORDER BY k DESC, start_min, row_id) AS place FROM sched")
def w16(spark, d):
    return audits.signal_order(programme(spark, d).withColumn("score", F.col("k")).withColumn("signal_id", F.col("row_id"))).select("signal_id", big("place").alias("place"))


@query("s18_source_plan", """WITH c AS (SELECT n_nationkey AS channel FROM nation), d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-12', INTERVAL 1 DAY)) AS DATE) AS date) SELECT channel, date, CAST(p AS BIGINT) AS page, date - DATE '2024-01-01' BETWEEN 1 AND 13 AND true AS reachable FROM c, d, (SELECT unnest([1, 2]) AS p)""")
def s18(spark, d):
    c = table(spark, d, "nation").select(F.col("n_nationkey").alias("channel"))
    return schedule.source_plan(c, F.lit("2024-01-06").cast("date"), F.lit("2024-01-01").cast("date"), 2).withColumn("page", big("page"))


@query("s19_learnt_plan", f"""WITH {SCHED}, t AS (SELECT DISTINCT channel FROM sched) SELECT channel, d AS date, 'https://g.example/' || channel || '/' || CAST(d AS VARCHAR) AS url FROM t, (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-02-03', TIMESTAMP '2024-02-09', INTERVAL 1 DAY)) AS DATE) AS d)""")
def s19(spark, d):
    s = programme(spark, d).withColumn("adapter", F.lit("a")).withColumn("source_url", F.concat(F.lit("https://g.example/"), F.col("channel"), F.lit("/"), F.col("date").cast("string")))
    return schedule.learnt_plan(s, F.lit("2024-02-03").cast("date")).select("channel", "date", "url")


@query("s17_distinct_observations", f"WITH {SCHED} SELECT date, channel, title, source AS source_url, arg_min(k, row_id) AS k FROM sched GROUP BY date, channel, title, source")
def s17(spark, d):
    s = programme(spark, d).select("date", F.lit("20:50").alias("start"), "channel", "title", F.col("source").alias("source_url"), "k", F.col("row_id").alias("plan_pos"))
    return schedule.distinct_observations(s).select("date", "channel", "title", "source_url", "k")


@query("a20_pagination_gaps", f"""WITH {SCHED}, p AS (SELECT channel AS source, date, CAST(k % 40 + 1 AS INTEGER) AS page, count(*) AS n FROM sched GROUP BY ALL), g AS (SELECT source, date, list(page) AS pages, sum(n) AS n FROM p GROUP BY ALL)
SELECT source, date, coalesce(array_to_string(list_filter(generate_series(1, 40), lambda x: NOT list_contains(pages, x)), ','), '') AS missing, n <> 60 AS total_differs FROM g""")
def a20(spark, d):
    p = programme(spark, d).groupBy(F.col("channel").alias("source"), "date", (F.col("k") % 40 + 1).alias("page")).agg(F.count("*").alias("n"))
    got = schedule.pagination_gaps(p.withColumn("total_pages", F.lit(40)).withColumn("total_products", F.lit(60)))
    return got.withColumn("missing", F.array_join(F.transform(F.sort_array(F.transform(F.filter(F.split("missing", ","), lambda x: x != ""), lambda x: x.cast("int"))), lambda x: x.cast("string")), ","))


@query("j09_slot_ladder", f"""WITH {SCHED}, s AS (SELECT row_id, date, start_min // 60 AS start_min, channel, title_key FROM sched), r AS (SELECT row_id AS c, date, (start_min + 30) // 60 AS start_min, channel, title_key FROM sched), e AS (SELECT s.row_id, 1 AS basis, c FROM s JOIN r USING (date, start_min, channel, title_key) UNION ALL SELECT s.row_id, 2, c FROM s JOIN r USING (date, start_min, channel)),
g AS (SELECT row_id, basis, min(c) AS c, count(DISTINCT c) AS n FROM e GROUP BY ALL), b AS (SELECT row_id, min(basis) AS basis FROM g GROUP BY ALL) SELECT s.row_id, CAST(b.basis AS BIGINT) AS basis, CASE WHEN n = 1 THEN c END AS candidate FROM s LEFT JOIN b USING (row_id) LEFT JOIN g ON g.row_id = b.row_id AND g.basis = b.basis""")
def j09(spark, d):
    """Rows by hours, an inventory of the same rows by hours from half past."""
    s = programme(spark, d).select("row_id", "date", "start_min", "channel", "title_key")
    hour = lambda shift: s.withColumn("start_min", F.floor((F.col("start_min") + shift) / 60).cast("int"))
    return identity.slot_ladder(hour(0), hour(30)).select("row_id", big("basis").alias("basis"), "candidate")


@query("j07_corrected_titles", f"""WITH {SCHED}, s AS (SELECT row_id, date, start_min // 240 AS start_min, channel, title_key FROM sched), r AS (SELECT row_id AS c, date, start_min, channel, unnest(CASE WHEN row_id % 3 = 0 THEN ['misread ' || row_id, title_key] ELSE ['misread ' || row_id] END) AS title_key FROM s),
e AS (SELECT s.row_id, 1 AS basis, c FROM s JOIN r USING (date, start_min, channel, title_key) UNION ALL SELECT s.row_id, 2, c FROM s JOIN r USING (date, start_min, channel) UNION ALL SELECT s.row_id, 3, c FROM s JOIN r USING (date, channel, title_key)),
g AS (SELECT row_id, basis, min(c) AS c, count(DISTINCT c) AS n FROM e GROUP BY ALL), b AS (SELECT row_id, min(basis) AS basis FROM g GROUP BY ALL)
SELECT s.row_id, CAST(b.basis AS BIGINT) AS basis, CASE WHEN n = 1 THEN c END AS candidate, n FROM s LEFT JOIN b USING (row_id) LEFT JOIN g ON g.row_id = b.row_id AND g.basis = b.basis""")
def j07(spark, d):
    """Reviews whose titles were misread, a third of them corrected: the corrected title joins."""
    s = programme(spark, d).withColumn("start_min", F.floor(F.col("start_min") / 240).cast("int")).select("row_id", "date", "start_min", "channel", "title_key")
    r = s.select("date", "start_min", "channel", F.concat(F.lit("misread "), F.col("row_id").cast("string")).alias("title_key"), F.when(F.col("row_id") % 3 == 0, F.col("title_key")).alias("reviewed_key"), F.col("row_id").alias("review_id"))
    return identity.review_ladder(s, r).select("row_id", big("basis").alias("basis"), "candidate", "n")


@query("j10_dossier_ladder", f"""WITH {WORKS}, l AS (SELECT id AS row_id, id * 2 AS link, title, year FROM works), e AS (SELECT row_id, 1 AS basis, w.id AS c FROM l JOIN works w ON w.id = l.link UNION ALL SELECT row_id, 2, w.id FROM l JOIN works w ON {KEY.format('w.title')} = {KEY.format('l.title')} AND w.year = l.year),
g AS (SELECT row_id, basis, min(c) AS c, count(DISTINCT c) AS n FROM e GROUP BY ALL), b AS (SELECT row_id, min(basis) AS basis FROM g GROUP BY ALL) SELECT row_id, CAST(basis AS BIGINT) AS basis, CASE WHEN n = 1 THEN c END AS candidate, n FROM b JOIN g USING (row_id, basis)""")
def j10(spark, d):
    w = works(spark, d).withColumn("links", F.create_map(F.lit("x"), F.concat(F.lit("u"), F.col("id").cast("string"))))
    ds = works(spark, d).select(F.col("id").alias("row_id"), "title", "year", F.create_map(F.lit("x"), F.concat(F.lit("u"), (F.col("id") * 2).cast("string"))).alias("links"))
    return identity.dossier_ladder(ds, w).select("row_id", big("basis").alias("basis"), "candidate", "n")


@query("j11_pick_plan", f"""WITH p AS (SELECT p_partkey AS pick_pos, p_name || ' ' || p_brand AS title, CASE WHEN p_partkey % 9 = 0 THEN p_partkey END AS work_id FROM part), o AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY pick_pos) AS r FROM p), w AS (SELECT p_name || ' ' || p_brand AS title, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), d AS (SELECT p_name || ' ' || p_brand AS title, max(CASE WHEN p_size > 25 THEN p_size END) AS y FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
SELECT pick_pos, CASE WHEN work_id IS NOT NULL THEN 'explicit' WHEN r > 1 THEN 'repeat' WHEN coalesce(n, 0) > 1 THEN 'clash' WHEN d.title IS NULL THEN 'needs_dossier' WHEN y IS NULL THEN 'needs_year' ELSE 'dossier' END AS status FROM o LEFT JOIN w USING (title) LEFT JOIN d USING (title)""")
def j11(spark, d):
    p = table(spark, d, "part").withColumn("title", F.concat_ws(" ", "p_name", "p_brand"))
    picks = p.select(F.col("p_partkey").alias("pick_pos"), "title", F.when(F.col("p_partkey") % 9 == 0, F.col("p_partkey")).alias("work_id"))
    return identity.pick_plan(picks, p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), "title"), p.where("p_partkey % 3 = 0").select("title", F.when(F.col("p_size") > 25, F.col("p_size")).alias("year"))).select("pick_pos", "status")


@query("j15_library_match", f"""WITH {WORKS}, i AS (SELECT id AS row_id, CASE WHEN id % 4 = 0 THEN 'tt' || CAST(id AS VARCHAR) END AS imdb, title || ' ' || director AS t, CASE WHEN id % 9 <> 0 THEN year END AS year FROM works),
l AS (SELECT id AS c, CASE WHEN id % 8 = 0 THEN 'tt' || CAST(id AS VARCHAR) END AS imdb, CASE id % 3 WHEN 0 THEN title || ' ' || director WHEN 1 THEN title ELSE 'x ' || title || ' ' || director || ' y' END AS t, CASE WHEN id % 10 <> 1 THEN year END AS ly FROM works),
q AS (SELECT row_id, year, c, ly FROM i JOIN l ON i.t = l.t),
v AS (SELECT * FROM q UNION SELECT row_id, year, c, ly FROM i JOIN l ON i.t <> l.t AND least(length(i.t), length(l.t)) >= 14 AND len(string_split(CASE WHEN length(i.t) <= length(l.t) THEN i.t ELSE l.t END, ' ')) >= 3 AND (contains(' ' || i.t || ' ', ' ' || l.t || ' ') OR contains(' ' || l.t || ' ', ' ' || i.t || ' '))),
y AS (SELECT row_id, 3 AS basis, year, c, ly FROM q UNION ALL SELECT row_id, 4, year, c, ly FROM v),
p AS (SELECT row_id, basis, CASE WHEN any_value(year) IS NULL THEN CASE WHEN count(*) = 1 THEN min(c) END WHEN count(*) FILTER (ly = year) > 0 THEN CASE WHEN count(*) FILTER (ly = year) = 1 THEN min(c) FILTER (ly = year) END
  WHEN count(*) FILTER (abs(ly - year) <= 1) = 1 THEN min(c) FILTER (abs(ly - year) <= 1) WHEN count(*) = 1 AND max(ly) IS NULL THEN min(c) END AS c FROM y GROUP BY row_id, basis),
e AS (SELECT row_id, 1 AS basis, c FROM i JOIN l USING (imdb) UNION ALL SELECT row_id, basis, c FROM p WHERE c IS NOT NULL), b AS (SELECT row_id, min(basis) AS basis FROM e GROUP BY ALL)
SELECT row_id, CAST(basis AS BIGINT) AS basis, c AS candidate FROM i LEFT JOIN b USING (row_id) LEFT JOIN e USING (row_id, basis)""")
def j15(spark, d):
    """Every part against a library of all parts under other names, some without a year."""
    w = works(spark, d).withColumn("name", F.concat_ws(" ", "title", "director"))
    tt = lambda n: F.when(F.col("id") % n == 0, F.concat(F.lit("tt"), F.col("id").cast("string"))).alias("imdb")
    none = F.lit(None).cast("string").alias("tmdb")
    dated = lambda cond: F.when(cond, F.col("year")).alias("year")
    items = w.select(F.col("id").alias("row_id"), F.col("name").alias("title"), tt(4), none, dated(F.col("id") % 9 != 0))
    other = F.when(F.col("id") % 3 == 0, F.col("name")).when(F.col("id") % 3 == 1, F.col("title")).otherwise(F.concat(F.lit("x "), F.col("name"), F.lit(" y")))
    lib = w.select(F.col("id").alias("lib_id"), other.alias("name"), tt(8), none, dated(F.col("id") % 10 != 1))
    return identity.library_match(items, lib).select("row_id", big("basis").alias("basis"), "candidate")


@query("j16_best_match", """WITH i AS (SELECT p_partkey AS row_id, p_name AS t, p_brand AS d, p_size AS y FROM part), c AS (SELECT p_partkey AS cand_id, CASE WHEN p_partkey % 2 = 0 THEN 'x ' || p_name || ' y' ELSE p_name END AS t, CASE WHEN p_partkey % 5 = 0 THEN 'zz' ELSE p_brand END AS d, p_size + p_partkey % 3 AS y FROM part),
e AS (SELECT row_id, cand_id, i.y AS iy, c.y AS cy, i.d AS di, c.d AS dc, CASE WHEN i.t = c.t THEN 85 ELSE 45 END AS pts FROM i JOIN c ON contains(' ' || c.t || ' ', ' ' || i.t || ' ') OR contains(' ' || i.t || ' ', ' ' || c.t || ' ')),
s AS (SELECT row_id, cand_id, pts + CASE abs(iy - cy) WHEN 0 THEN 40 WHEN 1 THEN 8 ELSE -80 END + CASE WHEN contains(di, dc) OR contains(dc, di) THEN 35 ELSE -20 END AS score FROM e)
SELECT row_id, cand_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, cand_id) AS r FROM s WHERE score >= 70) WHERE r = 1""")
def j16(spark, d):
    w, k = works(spark, d), F.col("id")
    none = F.lit(None).cast("string").alias("imdb")
    items = w.select(k.alias("row_id"), "title", none, "year", "director")
    title = F.when(k % 2 == 0, F.concat(F.lit("x "), F.col("title"), F.lit(" y"))).otherwise(F.col("title"))
    cand = w.select(k.alias("cand_id"), none, title.alias("title"), F.when(k % 5 == 0, "zz").otherwise(F.col("director")).alias("director"), (F.col("year") + k % 3).alias("year"))
    return identity.best_match(items, cand).select("row_id", "cand_id", big("score").alias("score"))


@query("j22_review_notes", f"""WITH {SCHED}, a AS (SELECT user_id AS page, k AS c, min(row_id) AS row_id FROM sched GROUP BY ALL HAVING count(*) = 1), b AS (SELECT user_id AS page, k * 3 % 100 AS c, min(row_id) AS note_id FROM sched GROUP BY ALL HAVING count(*) = 1) SELECT row_id, note_id FROM a JOIN b USING (page, c)""")
def j22(spark, d):
    """A user's rows as reviews of a page, and as notes on it under other titles."""
    s = programme(spark, d).withColumnRenamed("user_id", "page")
    notes = s.select(F.col("row_id").alias("note_id"), "page", (F.col("k") * 3 % 100).alias("compact"))
    return identity.merge_review_notes(s.select("row_id", "page", F.col("k").alias("compact")), notes)[0].select("row_id", "note_id")


@query("j23_placements", f"""WITH {SCHED}, w AS (SELECT min(row_id) AS want_id, title_key, channel, arg_min(start_min, row_id) AS start_min FROM sched GROUP BY title_key, channel), p AS (SELECT user_id AS pool_id, row_id AS pool_pos, title_key, channel, start_min FROM sched)
SELECT want_id, pool_id, pool_pos FROM w JOIN p USING (title_key) UNION SELECT want_id, pool_id, pool_pos FROM w JOIN p USING (channel, start_min)""")
def j23(spark, d):
    s = programme(spark, d)
    w = s.groupBy("title_key", "channel").agg(F.min("row_id").alias("want_id"), F.min_by("start_min", "row_id").alias("start_min"))
    p = s.select(F.col("user_id").alias("pool_id"), F.col("row_id").alias("pool_pos"), F.col("title_key").alias("p_title_key"), F.col("channel").alias("p_channel"), F.col("start_min").alias("p_start"))
    return identity.placements(w, p)


@query("j25_sample_in_inventory", f"""WITH {SCHED}, s AS (SELECT row_id, date, channel, start_min, title_key, user_id % 40 AS page FROM sched), i AS (SELECT DISTINCT date, channel, start_min, CASE WHEN k % 9 = 0 THEN 'other' ELSE title_key END AS title_key FROM sched)
SELECT row_id, 'not_in_inventory' AS problem FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE (i.date, i.channel, i.start_min, i.title_key) = (s.date, s.channel, s.start_min, s.title_key)) UNION ALL SELECT row_id, 'unknown_page' FROM s WHERE page NOT IN (SELECT n_nationkey FROM nation)""")
def j25(spark, d):
    """Every row as a sample; the inventory has other titles for some, and nations are the pages that are known."""
    s = programme(spark, d).withColumn("page", F.col("user_id") % 40)
    inventory = s.withColumn("title_key", F.when(F.col("k") % 9 == 0, "other").otherwise(F.col("title_key")))
    return identity.in_inventory(s, inventory, table(spark, d, "nation").select(F.col("n_nationkey").alias("page"))).select("row_id", "problem")


@query("a22_merge_ratings", """SELECT l_orderkey AS work_id, CAST(l_linenumber AS BIGINT) AS publisher, CASE WHEN l_partkey % 5 = 0 THEN 'blocked' WHEN l_partkey % 3 = 0 THEN 'proposed' WHEN l_partkey % 2 = 0 THEN 'agrees' ELSE 'differs' END AS status FROM lineitem""")
def a22(spark, d):
    li = table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("_"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("publisher"), "l_partkey")
    keyed = li.select(F.struct("o", "l_partkey", "_").alias("work_id"), "publisher", "l_partkey")
    cat = keyed.select("work_id", "publisher", F.when(F.col("l_partkey") % 3 != 0, F.when(F.col("l_partkey") % 2 == 0, 7.0).otherwise(5.0)).alias("current"), F.when(F.col("l_partkey") % 5 == 0, "none").alias("blocked_reason"))
    got = consensus.merge_ratings(keyed.select("work_id", "publisher", F.lit(7.0).alias("proposed")), cat)
    return got.select(F.col("work_id.o").alias("work_id"), "publisher", "status")


@query("a24_gap_fill", """WITH o AS (SELECT l_partkey AS work_id, ['senscritique', 'imdb', 'tmdb'][CAST(l_suppkey % 3 + 1 AS INTEGER)] AS source, CAST(min(l_quantity) AS INTEGER) AS q, CAST(min(l_suppkey % 4) AS INTEGER) AS y FROM lineitem GROUP BY ALL),
w AS (SELECT p_partkey AS work_id, CAST(1950 + p_size AS VARCHAR) AS expected, p_partkey % 2 = 0 AS no_duration, p_partkey % 3 <> 0 AS no_year, p_partkey % 5 < 3 AS no_country, p_partkey % 4 = 0 AS no_director, p_partkey % 8 = 0 AS no_creator, p_partkey % 7 IN (0, 1, 2) AS dossier FROM part),
f AS (SELECT w.*, (SELECT any_value(q || ' min') FROM o WHERE o.work_id = w.work_id AND source = 'senscritique') AS sc, (SELECT string_agg(source || ' ' || q || ' min', ', ' ORDER BY source) FROM o WHERE o.work_id = w.work_id AND source <> 'senscritique') AS others,
 (SELECT min(source) FROM o WHERE o.work_id = w.work_id AND 1950 + y * 10 = CAST(expected AS INTEGER)) AS dated FROM w),
v AS (SELECT *, coalesce(sc || CASE WHEN others IS NULL THEN '' ELSE ' (SensCritique ; ' || others || ')' END, CASE WHEN dossier THEN '88 min' END) AS duration FROM f)
SELECT 'w' || work_id || '-' || expected AS work_id, CASE WHEN no_duration THEN duration ELSE '90 min' END AS duration, CASE WHEN no_year THEN CASE WHEN dated IS NOT NULL THEN expected END ELSE '1999' END AS year, CASE WHEN no_country THEN CASE WHEN dossier THEN 'A / B' END ELSE 'C' END AS country,
 concat_ws(',', CASE WHEN no_country AND dossier THEN 'country=dossier' END, CASE WHEN no_duration AND duration IS NOT NULL THEN 'duration=' || CASE WHEN sc IS NULL THEN 'dossier' ELSE 'senscritique' END END, CASE WHEN no_year AND dated IS NOT NULL THEN 'year=' || dated END) AS changed,
 concat_ws(',', CASE WHEN no_year AND dated IS NULL THEN 'year' END, CASE WHEN no_director AND no_creator THEN 'director' END, CASE WHEN no_country AND NOT dossier THEN 'country' END, CASE WHEN no_duration AND duration IS NULL THEN 'duration' END, 'image') AS open_fields FROM v""")
def a24(spark, d):
    """Parts with gaps, lines as the offers of three sources, and dossiers of some parts."""
    key = F.concat(F.lit("w"), F.col("p_partkey").cast("string"), F.lit("-"), (F.col("p_size") + 1950).cast("string"))
    p = table(spark, d, "part").withColumn("work_id", key)
    k, text = F.col("p_partkey"), lambda cond, v: F.when(~cond, v)
    w = p.select("work_id", text(k % 3 != 0, "1999").alias("year"), text(k % 4 == 0, "X").alias("director"), text(k % 8 == 0, "Y").alias("creator"), text(k % 5 < 3, "C").alias("country"), F.lit("drame").alias("genre"), text(k % 2 == 0, "90 min").alias("duration"), F.lit(" ").alias("image"))
    source = F.element_at(F.array(F.lit("senscritique"), F.lit("imdb"), F.lit("tmdb")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    lines = table(spark, d, "lineitem").groupBy("l_partkey", source.alias("source")).agg(F.min("l_quantity").cast("int").alias("q"), F.min(F.col("l_suppkey") % 4).alias("y"))
    offered = lines.join(p.select("p_partkey", "work_id"), F.col("l_partkey") == F.col("p_partkey"))
    o = offered.select("work_id", "source", F.lit("u").alias("url"), F.col("source").alias("pos"), F.explode(F.array(F.struct(F.lit("duration").alias("field"), F.concat(F.col("q").cast("string"), F.lit(" min")).alias("value")), F.struct(F.lit("year").alias("field"), (1950 + F.col("y") * 10).cast("string").alias("value")))).alias("o")).select("work_id", "source", "url", "pos", "o.*")
    dossiers = p.where(k % 7 < 3).select("work_id", F.lit("A, B").alias("country"), F.lit(88).alias("minutes"), F.lit("dossier").alias("url"))
    out = consensus.fill_gaps(w, o, dossiers)
    changed = F.array_join(F.transform("changes", lambda c: F.concat_ws("=", c["field"], c["basis"])), ",")
    return out.select("work_id", "duration", "year", "country", changed.alias("changed"), F.array_join("open_fields", ",").alias("open_fields"))


@query("a30_scope_counts", "SELECT o_orderpriority AS scope, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def a30(spark, d):
    return planning.status_matrix(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "scope"), "scope", "o_orderstatus", ["O", "F", "P"])


_DAYS = "['samedi', 'dimanche', 'lundi', 'mardi', 'mercredi', 'jeudi', 'vendredi']"


@query("a32_task_board", f"""WITH e AS (SELECT event_id, user_id, event_type, {_DAYS}[CAST(user_id % 7 + 1 AS INTEGER)] AS day FROM events),
m AS (SELECT *, CASE event_type WHEN 'view' THEN upper(day[1]) || day[2:] || '-selection: ' || event_id % 9 || ' candidats (< 10) et shortage_reason non structuré' WHEN 'click' THEN 'Popularity radar reserve duplicates scan or public primary: ' || event_id
  WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'Popularity radar reserve too shallow' ELSE 'popularity radar distinct reserve too shallow' END WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'Full inventory-first coverage audit not completed' ELSE 'coverage full_week_reaudit_completed must be true' END
  ELSE 'Popularity radar reserve too shallow: ' || user_id END AS message FROM e),
a AS (SELECT CASE event_type WHEN 'view' THEN 'daily-reserve-' || day WHEN 'click' THEN 'radar-popularity-overlap' WHEN 'purchase' THEN 'radar-popularity-depth' WHEN 'signup' THEN 'coverage-full-week' ELSE 'observation-' || event_id END AS action,
 CASE event_type WHEN 'view' THEN 'Compléter les réserves de ' || day || ' ou documenter une pénurie réelle' WHEN 'click' THEN 'Réconcilier les réserves et la sélection du radar de popularité' WHEN 'purchase' THEN 'Compléter les réserves distinctes du radar de popularité' WHEN 'signup' THEN 'Achever et attester la revue des sept jours' ELSE message END AS title,
 CASE event_type WHEN 'view' THEN 'day' WHEN 'signup' THEN 'coverage' WHEN 'error' THEN 'global' ELSE 'radar' END AS kind, user_id % 11 = 3 AS blocking FROM m)
SELECT action, title, kind, bool_or(blocking) AS blocking, count(*) AS n FROM a GROUP BY ALL""")
def a32(spark, d):
    """Events as messages of validators; those that no rule knows stay apart, each an action of its own."""
    t, even, number = F.col("event_type"), F.col("user_id") % 2 == 0, lambda c: F.col(c).cast("string")
    day = F.element_at(F.array(*map(F.lit, planning.WEEKDAYS)), (F.col("user_id") % 7 + 1).cast("int"))
    message = (
        F.when(t == "view", F.concat(F.initcap(day), F.lit("-selection: "), (F.col("event_id") % 9).cast("string"), F.lit(" candidats (< 10) et shortage_reason non structuré")))
        .when(t == "click", F.concat(F.lit("Popularity radar reserve duplicates scan or public primary: "), number("event_id")))
        .when(t == "purchase", F.when(even, "Popularity radar reserve too shallow").otherwise("popularity radar distinct reserve too shallow"))
        .when(t == "signup", F.when(even, "Full inventory-first coverage audit not completed").otherwise("coverage full_week_reaudit_completed must be true"))
        .otherwise(F.concat(F.lit("Popularity radar reserve too shallow: "), number("user_id")))
    )
    e = table(spark, d, "events").select(F.col("event_id").alias("pos"), message.alias("message"), F.when(F.col("user_id") % 11 == 3, "blocking").otherwise("warning").alias("severity"))
    return planning.task_board(e)


@query("a36_leads", f"""WITH {SCHED}, e AS (SELECT title_key, count(DISTINCT date) AS weeks FROM sched WHERE channel = 'view' GROUP BY 1) SELECT title_key, count(*) AS n, CAST(CASE WHEN title_key LIKE '%1' THEN 2 ELSE 0 END AS BIGINT) AS n_matches, coalesce(max(weeks), 0) AS weeks FROM sched LEFT JOIN e USING (title_key) GROUP BY title_key""")
def a36(spark, d):
    s = programme(spark, d)
    index = s.where("title_key LIKE '%1'").select("title_key").distinct().withColumn("n_matches", F.lit(2).cast("long"))
    return planning.leads(s, index, s.where("channel = 'view'").select("title_key", F.col("date").alias("week")))


@query("a37_a38_packets", f"""WITH {SCHED} SELECT title_key, string_agg(DISTINCT channel, ',' ORDER BY channel) AS slots, coalesce(string_agg(DISTINCT CASE WHEN k < 20 THEN source END, ',' ORDER BY CASE WHEN k < 20 THEN source END), '') AS fields, string_agg(DISTINCT CAST(date AS VARCHAR), ',' ORDER BY CAST(date AS VARCHAR)) AS weeks FROM sched GROUP BY title_key""")
def a37(spark, d):
    s = programme(spark, d)
    return planning.evidence_packet(s, s.select("title_key", F.col("channel").alias("slot")), s.where("k < 20").select("title_key", F.col("source").alias("field")), s.select("title_key", F.col("date").cast("string").alias("week")))


@query("a43_initial_seeds", f"""WITH {SCHED}, s AS (SELECT row_id AS signal_id, title_key, date, k % 5 AS score FROM sched), g AS (SELECT row_id AS group_id, title_key, date FROM sched WHERE channel = 'purchase'), h AS (SELECT signal_id, min(group_id) AS group_id, count(DISTINCT group_id) AS n FROM s LEFT JOIN g USING (title_key, date) GROUP BY 1)
SELECT signal_id, CASE WHEN score < 2 THEN 'low_mark' WHEN n = 0 THEN 'no_group' WHEN n > 1 THEN 'several_groups' END AS reason, CASE WHEN score >= 2 AND n = 1 THEN group_id END AS group_id FROM s JOIN h USING (signal_id)""")
def a43(spark, d):
    s = programme(spark, d)
    sig = s.select(F.col("row_id").alias("signal_id"), "title_key", "date", (F.col("k") % 5).alias("score"))
    return planning.initial_seeds(sig, s.where("channel = 'purchase'").select(F.col("row_id").alias("group_id"), "title_key", "date", F.lit(True).alias("open"))).select("signal_id", "reason", "group_id")


@query("a44_grid_review", f"""WITH {SCHED}, c AS (SELECT row_id, date, channel, start_min, CASE WHEN row_id % 10 = 0 THEN 'fixed' ELSE replace(title, 'title', 'titre') END AS title FROM sched WHERE channel <> 'error' UNION ALL SELECT row_id, date, channel, start_min, title FROM sched WHERE channel = 'error') SELECT row_id, title, count(*) OVER (PARTITION BY date, channel) AS n_channel, row_number() OVER (PARTITION BY date, channel, start_min, title ORDER BY row_id) > 1 AS is_duplicate FROM c""")
def a44(spark, d):
    s = programme(spark, d).select("row_id", "date", "start_min", "channel", "title")
    fix = s.where("row_id % 10 = 0").withColumn("title", F.lit("fixed"))
    return schedule.apply_grid_review(s.where("channel <> 'error'"), fix, s.where("channel = 'error'"), [("^title", "titre")]).select("row_id", "title", "n_channel", "is_duplicate")


@query("a45_shortlist", f"""WITH {SCHED}, s AS (SELECT user_id AS card_id, row_id, row_number() OVER (PARTITION BY user_id ORDER BY k, row_id) AS r FROM sched), c AS (SELECT DISTINCT work_id, channel AS field, source AS url, scope FROM sched)
SELECT 'card' AS kind, CAST(card_id AS VARCHAR) AS id, CAST(row_id AS VARCHAR) AS value FROM s WHERE r = 1 UNION ALL SELECT 'record', coalesce(CAST(work_id AS VARCHAR), '-'), field || ' ' || url || ' ' || scope FROM c""")
def a45(spark, d):
    """Users as cards with their best row, and the compact records of all rows."""
    s = programme(spark, d)
    sig = s.select(F.col("user_id").alias("card_id"), F.col("row_id").alias("signal_id"), F.col("k").alias("priority"))
    rec = s.select("work_id", F.col("channel").alias("field"), F.col("source").alias("url"), "scope")
    cards, records = planning.shortlist(s.select(F.col("user_id").alias("card_id")).distinct(), sig, rec)
    text = lambda c: F.col(c).cast("string")
    return cards.select(F.lit("card").alias("kind"), text("card_id").alias("id"), text("signal_id").alias("value")).unionByName(records.select(F.lit("record").alias("kind"), F.coalesce(text("work_id"), F.lit("-")).alias("id"), F.concat_ws(" ", "field", "url", "scope").alias("value")))


@query("a46_image_decision", """WITH p AS (SELECT l_orderkey AS w, 'u' || CAST(l_linenumber AS VARCHAR) AS url, 'h' || CAST(l_linenumber % 2 AS VARCHAR) AS host, l_linenumber AS ladder, bool_and(l_partkey % 3 <> 0) AS ok FROM lineitem GROUP BY ALL),
g AS (SELECT w, max(CASE WHEN ladder = 1 THEN CAST(ok AS INTEGER) END) AS po, max(CASE WHEN ladder = 1 THEN url END) AS prim, min(CASE WHEN ok THEN ladder END) AS first_ok, arg_min(host, CASE WHEN ladder = 1 THEN -1 ELSE ladder END) AS mh FROM p GROUP BY w)
SELECT w AS work_id, CASE WHEN po = 1 THEN 'keep' WHEN first_ok IS NULL THEN 'unresolved' WHEN prim IS NULL THEN 'add' ELSE 'repair' END AS status, CASE WHEN po = 1 THEN prim ELSE 'u' || CAST(first_ok AS VARCHAR) END AS image FROM g""")
def a46(spark, d):
    n = F.col("l_linenumber")
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("work_id"), "l_linenumber").agg(F.bool_and(F.col("l_partkey") % 3 != 0).alias("ok"))
    p = p.select("work_id", F.concat(F.lit("u"), n.cast("string")).alias("url"), F.concat(F.lit("h"), (n % 2).cast("string")).alias("host"), n.alias("ladder"), "ok", (n == 1).alias("is_primary"))
    return consensus.image_decision(p).select("work_id", "status", "image")


@query("f02_f03_f04_filters", "SELECT o_orderkey, o_orderstatus = 'O' AND strftime(o_orderdate, '%Y-%m') = '1998-10' AS in_calendar, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, 'a-recuperer') = 'a-recuperer' AS watched, CAST(o_orderdate AS DATE) BETWEEN DATE '1998-10-03' AND DATE '1998-10-09' AS in_week FROM orders")
def f02(spark, d):
    o = table(spark, d, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", predicates.calendar_filter(F.col("o_orderstatus"), day, "O", "1998-10").alias("in_calendar"), predicates.watch_filter(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus"))).alias("watched"), predicates.in_week(day, F.lit("1998-10-03").cast("date"), F.lit("1998-10-09").cast("date")).alias("in_week"))


@query("f09_f10_reserve_eligible", """SELECT p_partkey, p_size > 5 AND (p_partkey % 2 = 0 OR p_size > 20) AS early, p_size > 5 AND (p_partkey % 2 = 0 OR p_size > 20) AND p_partkey % 3 = 0 AS late FROM part""")
def f09(spark, d):
    p = table(spark, d, "part")
    x = F.lit("x")
    r = {"image": x, "director": F.col("p_brand"), "year": F.col("p_size"), "identity": F.col("p_size") > 5, "ratings": F.when(F.col("p_partkey") % 2 == 0, F.create_map(x, x)), "reason": F.when(F.col("p_size") > 20, "aucune note sur les sites consultés"), "country": x, "duration": x, "genre": F.when(F.col("p_partkey") % 3 == 0, x), "summary": F.lit("s" * 45), "why": F.lit("w" * 45)}
    return p.select("p_partkey", predicates.reserve_eligible(r, F.lit("2024-S01"), "2024-S10").alias("early"), predicates.reserve_eligible(r, F.lit("2024-S10"), "2024-S10").alias("late"))


@query("f11_f13_evidence_rules", """WITH e AS (SELECT event_id, event_type, user_id, value, CAST(props->>'$.k' AS INTEGER) AS k, ts FROM events),
s AS (SELECT *, CASE WHEN value > 90 THEN 'https://x.org/' || event_id WHEN value > 80 THEN 'ftp://x.org/' END AS url, CASE WHEN event_type <> 'view' THEN 'sha256:' || user_id % 3 END AS digest, CASE WHEN k % 4 > 0 THEN CAST(k AS INTEGER) END AS page, CASE WHEN k % 3 > 0 THEN k % 5 END AS box FROM e)
SELECT event_id, CASE WHEN url LIKE 'https://%' THEN NULL WHEN digest IS NULL THEN 'no_source' WHEN digest <> 'sha256:1' THEN 'digest' WHEN coalesce(page, 0) < 1 THEN 'page' WHEN coalesce(box, 0) <> 4 THEN 'box' END AS error,
 concat_ws(',', CASE WHEN url IS NULL OR url NOT LIKE 'https://%' THEN 'url' END, CASE WHEN event_type NOT IN ('view', 'click', 'signup') THEN 'field' END, CASE WHEN k >= 75 THEN 'result' END, CASE WHEN k < 50 AND value < 20 THEN 'value' END, CASE WHEN user_id % 4 = 3 THEN 'stability' END) AS codes FROM s""")
def f11(spark, d):
    """Events as evidence: their value tells the URL, their user the digest, their number the page, box and result."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, v, u, text = F.col("k"), F.col("value"), F.col("user_id"), lambda c: c.cast("string")
    url = F.when(v > 90, F.concat(F.lit("https://x.org/"), text(F.col("event_id")))).when(v > 80, F.concat(F.lit("ftp://x.org/"), text(F.col("event_id"))))
    digest = F.when(F.col("event_type") != "view", F.concat(F.lit("sha256:"), text(u % 3)))
    box = F.when(k % 3 > 0, F.slice(F.array(*[v] * 4), 1, k % 5))
    err = predicates.evidence_error(url, digest, F.when(k % 4 > 0, k), box, F.lit("sha256:1"))
    result = F.when(k < 50, "found").when(k < 75, "not_found").otherwise("maybe")
    r = {"url": url, "checked_at": F.col("ts"), "field": F.col("event_type"), "result": result, "value": F.when(v >= 20, F.col("props")).otherwise(" "), "stability": F.when(u % 4 == 3, "odd").when(u % 4 == 2, "stable")}
    return e.select("event_id", err.alias("error"), F.array_join(predicates.evidence_errors(r, ["view", "click", "signup"]), ",").alias("codes"))


@query("f14_f19_f21_contracts", """WITH p AS (SELECT *, string_split(p_name, ' ') AS names, p_retailprice / 100 AS x FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN p_size - 3 < 0 OR x > 15 OR p_size - 3 >= x THEN 'box' END, CASE WHEN p_size > 47 THEN 'start' END, CASE WHEN NOT list_has_all(['widget', 'rod', 'small', 'large', 'red', 'blue'], names) THEN 'fields' END) AS contract,
 concat_ws(',', CASE WHEN length(p_type || ' ' || p_name) < 24 THEN 'reason' END, CASE WHEN len(list_distinct(list_append(names, 'rod'))) < 2 THEN 'sources' END, CASE WHEN length(p_name) <> p_size % 20 THEN 'count' END) AS shortage,
 concat_ws(',', CASE WHEN p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'context' END, CASE WHEN length(trim(p_type || ' ' || p_brand)) < 20 THEN 'reason' END) AS exc FROM p""")
def f14(spark, d):
    """Parts as records with a box of size and price, the words of their names as fields and sources, and their types as reasons."""
    p, s, x = table(spark, d, "part"), F.col("p_size"), F.col("p_retailprice") / 100
    names, dbl = F.split("p_name", " "), lambda c: c.cast("double")
    start = F.format_string("%02d:%02d", F.floor(s / 2).cast("int"), s)
    con = predicates.contract_errors(F.array(dbl(s - 3), F.lit(0.0), x, F.lit(9.0)), F.lit(15.0), F.lit(20.0), start, F.array(*map(F.lit, ("widget", "rod", "small", "large", "red", "blue"))), names)
    sh = predicates.shortage_errors(F.concat_ws(" ", "p_type", "p_name"), F.array_append(names, F.lit("rod")), s % 20, F.length("p_name"))
    ex = predicates.exception_errors(F.col("p_brand"), F.concat_ws(" ", "p_type", "p_brand"), ["Brand#1", "Brand#2", "Brand#3"])
    j = lambda c: F.array_join(c, ",")
    return p.select("p_partkey", j(con).alias("contract"), j(sh).alias("shortage"), j(ex).alias("exc"))


@query("f15_f16_f17_scopes", """WITH e AS (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k, CAST(ts AS DATE) AS day FROM events), r AS (SELECT *, CASE WHEN k % 5 > 0 THEN ts + to_hours(k - 20) END AS retry, CASE WHEN k % 3 > 0 THEN ts + to_hours(CAST(user_id % 90 AS INTEGER)) END AS expires FROM e)
SELECT event_id, k < 50 OR event_type = 'view' OR event_type = 'click' AS scoped, (event_type = 'click') AND (k % 2 = 1 OR day = DATE '2024-01-10') AS paused,
 CASE WHEN retry IS NULL OR retry < ts OR expires < retry THEN 'invalid' WHEN expires <= TIMESTAMP '2024-01-15 00:00:00' THEN 'expired' WHEN retry <= TIMESTAMP '2024-01-15 00:00:00' THEN 'reopened' ELSE 'waiting' END AS state FROM r""")
def f15(spark, d):
    """Constraints, pauses and retries that follow from the numbers, days and times of events."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("ts", F.col("ts").cast("timestamp"))
    k, t, none = F.col("k"), F.col("event_type"), F.lit(None).cast("string")
    later = lambda h: F.col("ts") + F.make_dt_interval(hours=h.cast("int"))
    state = predicates.retry_state(F.col("ts"), F.when(k % 5 > 0, later(k - 20)), F.when(k % 3 > 0, later(F.col("user_id") % 90)), F.lit("2024-01-15").cast("timestamp"))
    pause = {"date": F.when(k % 2 == 0, "2024-01-10"), "channel": F.lit("click"), "version": none, "offer": none}
    obs = {"date": F.col("ts").cast("date").cast("string"), "channel": t, "version": F.col("props"), "offer": none}
    scope = F.when(k >= 50, F.array(F.lit("view"), F.lit("click")))
    return e.select("event_id", predicates.scope_matches(scope, t).alias("scoped"), predicates.pause_covers(pause, obs).alias("paused"), state.alias("state"))


@query("f06_f08_identity_links", f"""WITH {LINKS} SELECT l_orderkey, l_linenumber, CASE k WHEN 3 THEN whole WHEN 7 THEN f = 'N' OR (f = 'A' AND NOT whole) ELSE f <> 'R' AND k IN (1, 2, 4) END AS strong, CASE k WHEN 7 THEN f = 'N' OR (f = 'A' AND NOT whole) WHEN 3 THEN whole ELSE f <> 'R' AND k IN (1, 2) END AS strong_elsewhere,
CASE WHEN k = 1 AND NOT (f = 'A' AND length(cents) >= 7) THEN 'imdb_shape' WHEN k = 3 AND NOT (f <> 'R' AND whole) THEN 'sc_shape' END AS shape FROM l""")
def f06(spark, d):
    """Links of seven kinds, each alone on its work; a profile other than the reserve's leaves one kind out."""
    links = F.create_map("kind", "url")
    return line_links(spark, d).select("l_orderkey", "l_linenumber", predicates.strong_identity(links).alias("strong"), predicates.strong_identity(links, "other").alias("strong_elsewhere"), predicates.link_shape_error(F.col("kind"), F.col("url")).alias("shape"))


@query("p19_p23_p38_rating_lines", """SELECT p_partkey, 'IMDb=' || CAST(p_size AS VARCHAR) || '/10 et presse=' || CAST(p_size AS VARCHAR) || '/5' AS note, replace(lower(p_brand), '#', ' ') AS channel FROM part""")
def p19(spark, d):
    s = F.col("p_size").cast("string")
    e = parse.rating_entries(F.create_map(F.lit("imdb"), s, F.lit("presse"), F.concat(s, F.lit("/5"))), {"imdb": "IMDb"})
    note = parse.ratings_note(F.transform(e, lambda x: F.concat(x["label"], F.lit("="), x["text"])))
    return table(spark, d, "part").select("p_partkey", note.alias("note"), parse.canonical_channel(F.col("p_brand")).alias("channel"))


@query("p31_p32_p33_p40_projections", f"""WITH s AS (SELECT event_id, event_type AS t, value AS v, CAST(props->>'$.k' AS INTEGER) AS k, 'https://u' || user_id || '.org' AS u FROM events)
SELECT event_id, CASE WHEN v >= 12 THEN 'found' WHEN v < 3 THEN 'found' WHEN v < 6 THEN 'not_found' WHEN v < 9 THEN 'unclear' END AS result, CASE t WHEN 'error' THEN 'year' ELSE t END AS field, CASE WHEN v > 20 THEN 'as said' WHEN t IN ('offer', 'broadcast') THEN 'dynamic' ELSE 'stable' END AS stability, CAST(CASE WHEN k % 6 < 5 THEN k % 6 END AS BIGINT) AS mark, k % 3 = 0 OR (k % 3 = 1 AND v >= 1) AS family,
CASE WHEN v > 5 AND k % 2 = 0 THEN 'https://v.org,' || u WHEN v > 5 THEN 'https://v.org' ELSE u END AS urls FROM (SELECT * REPLACE (CASE t WHEN 'view' THEN 'broadcast' WHEN 'click' THEN 'offer' ELSE t END AS t) FROM s)""")
def p31(spark, d):
    """Events as evidence in both shapes: compact ones from a value on, legacy ones below, statuses by value, fields by type."""
    v, k = F.col("value"), F.get_json_object("props", "$.k").cast("int")
    own = F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".org"))
    kind = F.col("event_type")
    field = F.when(kind == "view", "broadcast").when(kind == "click", "offer").when(kind != "error", kind)
    status = F.when(v < 3, "confirmed").when(v < 6, "missing").when(v < 9, "in doubt")
    r = {"url": F.when(v > 5, "https://v.org"), "source_urls": F.array(own), "status": status, "result": F.when(v >= 12, "found"), "field": field, "fields": F.array(F.lit(None).cast("string"), F.lit("year")), "value": F.lit(None).cast("string"), "stability": F.when(v > 20, "as said")}
    e = parse.evidence_view(r)
    mark = F.element_at(F.array(*map(F.lit, (*parse.MARKS, "zz"))), k % 6 + 1)
    page = F.when(k % 3 == 0, "cinema").when((k % 3 == 1) & (v >= 1), F.concat(F.lit("cinema-"), v.cast("int").cast("string"))).when(k % 3 == 1, "cinema-").otherwise(F.concat(F.lit("cinema"), k.cast("string")))
    urls = parse.evidence_urls(F.array(e["url"]), F.array(F.lit("ftp://x"), F.when(k % 2 == 0, own), F.lit("")))
    return table(spark, d, "events").select("event_id", e["result"].alias("result"), e["field"].alias("field"), e["stability"].alias("stability"), big(parse.mark_score(mark)).alias("mark"), parse.section_matches(page, "cinema").alias("family"), F.array_join(urls, ",").alias("urls"))


@query("p25_p26_p35_p43_texts", """WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 1440 AS INTEGER) AS m FROM orders)
SELECT o_orderkey, 'Jane ' || o_orderstatus AS director, CASE WHEN o_totalprice > 150000 THEN o_orderpriority || ',' ELSE '' END || o_orderstatus AS images, CASE WHEN o_custkey % 3 = 0 AND o_orderpriority >= '3' THEN 'offer' ELSE '' END AS missing,
 CASE o_custkey % 3 WHEN 0 THEN day - 1 WHEN 1 THEN day ELSE day - 40 END + to_minutes(m) AS at FROM o""")
def p25(spark, d):
    """Orders as topics: activity yesterday, today or some weeks before their date, images and offers by price and priority."""
    o, months = table(spark, d, "orders"), F.array(*map(F.lit, FRENCH_MONTHS))
    day, c = F.col("o_orderdate").cast("date"), F.col("o_custkey") % 3
    m = (F.col("o_orderkey") % 1440).cast("int")
    clock, before = clock_text(m), F.date_sub(day, 40)
    said = F.when(c == 0, F.concat(F.lit("Hier "), clock)).when(c == 1, F.concat(F.lit("Aujourd'hui, "), clock)).otherwise(F.concat(F.dayofmonth(before).cast("string"), F.lit(" "), F.element_at(months, F.month(before)), F.lit(" "), F.year(before).cast("string"), F.lit(" "), clock))
    spec = F.struct(F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderpriority") < "3", F.col("o_orderstatus")).alias("offer"))
    facts = parse.section_facts(spec, F.struct(F.lit("y").alias("title"), F.when(c != 0, "z").alias("offer")), ["title", "offer"])
    images = parse.image_order(F.when(F.col("o_totalprice") > 150000, F.col("o_orderpriority")), F.array("o_orderstatus", F.lit("")), F.array("o_orderstatus"))
    at = parse.french_activity_time(said, F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 12 HOURS"))
    return o.select("o_orderkey", parse.clean_director(F.concat(F.lit("Jane "), F.col("o_orderstatus"), F.lit(" [VOSTFR]"))).alias("director"), F.array_join(images, ",").alias("images"), F.array_join(facts["missing"], ",").alias("missing"), at.cast("timestamp_ntz").alias("at"))


@query("w09_refill", f"""WITH {SCHED}, c AS (SELECT DISTINCT user_id, k AS work_id FROM sched), s AS (SELECT DISTINCT user_id, k AS work_id FROM sched WHERE channel = 'purchase'), l AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE (s.user_id, s.work_id) = (c.user_id, c.work_id))), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY work_id % 3 = 0, work_id) AS slot FROM l)
SELECT user_id, work_id, slot, CAST((slot + 4) // 5 AS BIGINT) AS page FROM o""")
def w09(spark, d):
    s = programme(spark, d)
    cards = s.select("user_id", F.col("k").alias("work_id"), F.concat(F.lit("t"), F.col("k").cast("string")).alias("title"), F.col("k").alias("pos")).distinct()
    seen = s.where("channel = 'purchase'").select("user_id", F.col("k").alias("work_id"), F.lit(None).cast("string").alias("title"))
    return personal.grid_refill(cards.where("work_id % 3 <> 0"), seen, cards.where("work_id % 3 = 0"), 5).select("user_id", "work_id", big("slot").alias("slot"), big("page").alias("page"))


@query("f25_append_contract", f"""WITH {POOL}, e AS (SELECT * FROM pool WHERE rank <= 8 + pool_id % 3), n AS (SELECT pool_id, CASE WHEN pool_id % 4 = 0 AND rank = 9 + pool_id % 3 THEN (SELECT min(work_id) FROM e x WHERE x.pool_id = pool.pool_id) ELSE work_id END AS work_id, rank + CASE WHEN pool_id % 5 = 0 THEN 1 ELSE 0 END AS rank FROM pool WHERE rank > 8 + pool_id % 3),
g AS (SELECT pool_id, max(rank) AS tail, max(rank) = count(*) AS contiguous FROM e GROUP BY 1), m AS (SELECT pool_id, min(rank) AS lo, max(rank) AS hi, count(*) AS c FROM n GROUP BY 1) SELECT pool_id, contiguous, CAST(CASE WHEN pool_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS known_works, lo = tail + 1 AND hi = tail + c AS continues FROM g JOIN m USING (pool_id)""")
def f25(spark, d):
    """Whole pools: the first ranks are there, all others are appended, some with a work that is there or a rank left out."""
    p = pool(spark, d)
    tail = F.col("pool_id") % 3 + 8
    e = p.where(F.col("rank") <= tail)
    least = e.groupBy("pool_id").agg(F.min("work_id").alias("m"))
    n = p.where(F.col("rank") > tail).join(least, "pool_id").withColumn("work_id", F.when((F.col("pool_id") % 4 == 0) & (F.col("rank") == tail + 1), F.col("m")).otherwise(F.col("work_id")))
    return planning.append_contract(e, n.withColumn("rank", F.col("rank") + F.when(F.col("pool_id") % 5 == 0, 1).otherwise(0)))


@query("u02_u06_u07_sets", f"""WITH {OCC}, t AS (SELECT DISTINCT week, title_key FROM occ WHERE qty > 25 OR qty < 20), n AS (SELECT week, count(*) AS n FROM t GROUP BY week),
a AS (SELECT week, list_sort(list_distinct(list(pool_id % 7) FILTER (qty > 40))) AS hi, list_sort(list_distinct(list(pool_id % 7) FILTER (qty < 8))) AS lo FROM occ GROUP BY week)
SELECT week, n, coalesce(hi, []) = coalesce(lo, []) AS same, array_to_string(list_concat(coalesce(hi, []), list_filter(coalesce(lo, []), lambda x: NOT list_contains(coalesce(hi, []), x))), ',') AS merged FROM n JOIN a USING (week)""")
def u02(spark, d):
    """Titles of two sources by week, and the pools of much and of little as sets."""
    occ = occurrences(spark, d)
    v = readers.visual_titles(occ.where("qty > 25"), occ.where("qty < 20 OR qty > 40")).groupBy("week").agg(F.count("*").alias("n"))
    pools = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("pool_id") % 7)))
    sets = occ.groupBy("week").agg(pools(F.col("qty") > 40).alias("hi"), F.collect_set(F.when(F.col("qty") < 8, F.col("pool_id") % 7)).alias("lo"))
    return v.join(sets, "week").select("week", "n", readers.same_set(F.col("hi"), F.col("lo")).alias("same"), F.array_join(readers.ordered_union(F.col("hi"), F.array_sort("lo")), ",").alias("merged"))


@query("l02_watch_order", f"""WITH {SCHED}, w AS (SELECT user_id, title_key, max(k) AS priority, max(ts) AS added FROM sched GROUP BY ALL) SELECT user_id, title_key, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(CASE WHEN priority % 3 <> 0 THEN priority END, 1) DESC, added DESC, title_key) AS place FROM w""")
def l02(spark, d):
    from pyspark.sql import Window

    w = programme(spark, d).groupBy("user_id", "title_key").agg(F.max("k").alias("p"), F.max("ts").alias("added")).withColumn("priority", F.when(F.col("p") % 3 != 0, F.col("p")))
    return w.select("user_id", "title_key", big(F.row_number().over(Window.partitionBy("user_id").orderBy(*readers.watch_order()))).alias("place"))


@query("t07_enrich_topics", f"""WITH {WORKS}, t AS (SELECT id AS topic_id, title, year FROM works) SELECT topic_id, t.title, CAST(t.year AS BIGINT) AS year, w.id AS work_id FROM t LEFT JOIN works w ON w.title = t.title AND w.year = t.year""")
def t07(spark, d):
    from gridloom.streaming import jobs

    w = works(spark, d)
    t = w.select(F.col("id").alias("topic_id"), F.concat(F.lit("[X] "), F.replace("title", F.lit(" "), F.lit(".")), F.lit(" ("), F.col("year").cast("string"), F.lit(") 720p")).alias("topic_title"))
    return jobs.enrich(t, w).select("topic_id", "title", big("year").alias("year"), "work_id")


def clock_text(start_min):
    """Minutes as ``HH:MM``."""
    return F.format_string("%02d:%02d", F.floor(start_min / 60).cast("int"), start_min % 60)


@query("s15_grid_cells", f"WITH {SCHED} SELECT row_id AS page_key, lpad(CAST(start_min // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_min % 60 AS VARCHAR), 2, '0') AS time, channel, title AS programme FROM sched")
def s15(spark, d):
    from gridloom.sources import captures

    s = programme(spark, d)
    cell = lambda k, c: F.concat(F.lit(f'<td class="{k}">'), c, F.lit("</td>"))
    html = F.concat(F.lit("<table><tr><th>x</th></tr><tr>"), cell("time", clock_text(F.col("start_min"))), cell("chan", F.col("channel")), cell("prog", F.concat(F.lit("<b>"), F.col("title"), F.lit("</b>"))), F.lit("</tr></table>"))
    return captures.grid_rows(s.select(F.col("row_id").alias("page_key"), html.alias("html"))).select("page_key", "time", "channel", "programme")


@query("a38_coverage_flags", f"WITH {SCHED} SELECT title_key, CAST(sum(CASE WHEN k < 50 THEN 1 ELSE 0 END) AS BIGINT) AS covered, string_agg(DISTINCT channel, ',' ORDER BY channel) AS statuses FROM sched GROUP BY 1")
def a38(spark, d):
    return planning.coverage_flags(programme(spark, d).select("title_key", (F.col("k") < 50).alias("covered"), F.col("channel").alias("status")))




@query("p36_image_kinds", r"""WITH p AS (SELECT page_id, CASE WHEN contains(url, '#') THEN '' ELSE regexp_extract(coalesce(html, ''), '<html lang="([a-z]+)"', 1) END AS lang, length(coalesce(html, '')) % 14 AS n FROM pages) SELECT page_id, CASE WHEN lang = 'en' AND n >= 3 THEN 'jpeg' WHEN lang = 'de' AND n >= 8 THEN 'png' WHEN lang = 'fr' AND n >= 4 THEN 'gif' WHEN lang = 'es' AND n >= 12 THEN 'webp' WHEN lang NOT IN ('en', 'de', 'fr', 'es') AND n <= 10 THEN 'svg' END AS kind FROM pages JOIN p USING (page_id)""")
def p36(spark, d):
    """A head by the language of a page, cut off by the length of it, before the page's own bytes; for urls with a fragment, an element beyond more and more blanks."""
    html = F.coalesce("html", F.lit(""))
    lang, n = F.when(F.contains("url", F.lit("#")), "").otherwise(F.regexp_extract(html, '<html lang="([a-z]+)"', 1)), F.length(html) % 14
    heads = {"en": "FFD8FFE000104A4649460001", "de": "89504E470D0A1A0A0000000D49484452", "fr": "474946383961E803E8030000", "es": "524946462400000057454250"}
    head = F.encode(F.concat(F.repeat(F.lit(" "), n * 24), F.lit("<SVG ")), "UTF-8")
    for k, h in heads.items():
        head = F.when(lang == k, F.substring(F.unhex(F.lit(h)), F.lit(1), n)).otherwise(head)
    return table(spark, d, "pages").select("page_id", parse.image_kind(F.concat(head, F.encode(html, "UTF-8"))).alias("kind"))


@query("f20_posters", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'path,' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN 'digest,' ELSE '' END || CASE WHEN octet_length(encode(coalesce(html, ''))) > 2000 THEN 'weight,' ELSE '' END AS errors FROM pages""")
def f20(spark, d):
    k, content = F.col("page_id"), F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    path = F.concat(F.lit("posters/"), F.when(k % 3 == 0, "other").otherwise(k.cast("string")), F.lit(".webp"))
    declared = F.when(k % 5 == 0, "no digest").otherwise(F.sha2(content, 256))
    errors = predicates.poster_errors(k.cast("string"), path, declared, content, 2_000)
    return table(spark, d, "pages").select("page_id", F.concat(F.array_join(errors, ","), F.when(F.size(errors) > 0, ",").otherwise("")).alias("errors"))
