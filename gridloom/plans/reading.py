"""Registered queries of readers, sinks and streams, over documents and captures made of whole tables.

An order is a document of its lines, and a customer's orders, or a user's half days, are
a capture: groups that don't grow with the tables. The queries write or parse real JSON, XML
and HTML text; their SQL says what the rows were before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.calendar import FRENCH_MONTHS, issue_from, week_of_saturday, weekday_name
from gridloom.operators import personal
from gridloom.plans.frames import table
from gridloom.plans.more import clock_text
from gridloom.plans.queries import big, query
from gridloom.sources import captures, documents, sinks
from gridloom.staging import Scratch, staged
from gridloom.streaming import jobs, tables

#: What orders the lines of an order; lines equal in all of it are equal in every query here.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
_BY = ", ".join(LINE_ORDER)
_WEEK = "strftime(CAST({0} AS DATE) - CAST((isodow({0}) + 1) % 7 AS INTEGER) + 2, '%G-S%V')"
_CLOCK = "lpad(CAST({0} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0')"


def _lines(spark, d) -> DataFrame:
    """``order, lines``: the lines of each order as a sorted array."""
    li = table(spark, d, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    return li.groupBy(F.col("l_orderkey").alias("order")).agg(F.sort_array(F.collect_list(F.struct(*LINE_ORDER))).alias("lines"))


def _candidate(x: Column) -> Column:
    return F.struct(F.concat(F.lit('"Part" '), x["l_partkey"].cast("string")).alias("title"), x["l_partkey"].cast("string").alias("work_id"), x["l_quantity"].cast("int").alias("rank"))


def _parsed(rows: DataFrame, doc: Column, schema: str) -> DataFrame:
    """Documents written as JSON text and read back by a fixed schema."""
    text = rows.select(F.to_json(doc).alias("body"))
    return text.select(F.from_json("body", schema).alias("j")).select("j.*")


@query("s02_issues", f"""WITH o AS (SELECT {_WEEK.format('o_orderdate')} AS week, CAST(o_orderdate AS DATE) - CAST((isodow(o_orderdate) + 1) % 7 AS INTEGER) AS "from", o_orderpriority, o_orderstatus FROM orders),
m AS (SELECT week, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) * 3 > count(*) AS draft FROM o GROUP BY week), c AS (SELECT week FROM m WHERE NOT draft ORDER BY week DESC LIMIT 52)
SELECT week, "from", o_orderpriority AS id, '<p>' || count(*) || '</p>' AS html FROM o WHERE week IN (SELECT week FROM c) GROUP BY ALL""")
def s02(spark, d):
    """Issues of orders by week, a page a priority, written by week; those of the newest 52 weeks in the manifest that are no drafts are read."""
    o = table(spark, d, "orders").withColumn("from", issue_from(F.col("o_orderdate").cast("date"))).withColumn("week", week_of_saturday(F.col("from")))
    page = F.struct(F.col("o_orderpriority").alias("id"), F.lit("page").alias("className"), F.concat(F.lit("<p>"), F.col("n").cast("string"), F.lit("</p>")).alias("html"))
    issue = o.groupBy("week", "from", "o_orderpriority").agg(F.count("*").alias("n")).groupBy("week", "from").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    draft = F.sum((F.col("o_orderstatus") == "O").cast("int")) * 3 > F.count("*")
    manifest = o.groupBy("week").agg(F.when(draft, "draft").otherwise("published").alias("status"))
    with Scratch(spark, "issues") as tmp:
        path = f"{tmp.path}/issues"
        issue.hint("rebalance", F.col("week")).write.partitionBy("week").json(path)
        read = documents.issues(spark, path, manifest, lookback=52)
        return staged(read.select("week", "from", F.explode("pages").alias("p")).select("week", "from", "p.id", "p.html"), "issue-pages")


@query("s03_inventory_rows", f"""WITH x AS (SELECT *, CAST(l_shipdate AS DATE) AS date FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS week, date, row_number() OVER (PARTITION BY l_orderkey, date ORDER BY {_BY}) - 1 AS pos, CAST(l_partkey AS VARCHAR) AS title, CAST(l_suppkey AS VARCHAR) AS channel, CAST(l_linenumber AS BIGINT) AS pdf_page FROM x""")
def s03(spark, d):
    """An inventory an order: a day a shipping date, an item a line."""
    item = lambda x: F.struct(x["l_partkey"].cast("string").alias("title"), x["l_suppkey"].cast("string").alias("channel"), x["l_linenumber"].alias("pdf_page"))
    dates = F.array_distinct(F.transform("lines", lambda x: x["l_shipdate"]))
    days = F.transform(dates, lambda day: F.struct(day.alias("date"), F.transform(F.filter("lines", lambda x: x["l_shipdate"] == day), item).alias("items")))
    docs = _parsed(_lines(spark, d), F.struct(F.col("order").cast("string").alias("week"), days.alias("days")), documents.INVENTORY_SCHEMA)
    return documents.inventory_rows(docs).select("week", "date", big("pos").alias("pos"), "title", "channel", big("pdf_page").alias("pdf_page"))


@query("s04_pool_rows", f"""SELECT CAST(l_orderkey AS VARCHAR) AS week, 'supplier ' || l_suppkey AS pool_id, 'page' || l_suppkey % 5 AS page_id, count(*) OVER p AS target, row_number() OVER (p ORDER BY {_BY}) - 1 AS pos, '"Part" ' || l_partkey AS title, CAST(l_partkey AS VARCHAR) AS work_id, CAST(l_quantity AS BIGINT) AS rank FROM lineitem WINDOW p AS (PARTITION BY l_orderkey, l_suppkey)""")
def s04(spark, d):
    """An issue an order, a pool a supplier in it."""
    suppliers = F.array_distinct(F.transform("lines", lambda x: x["l_suppkey"]))

    def entry(s: Column) -> Column:
        mine = F.filter("lines", lambda x: x["l_suppkey"] == s)
        pool = F.struct(F.concat(F.lit("page"), (s % 5).cast("string")).alias("page_id"), F.size(mine).alias("target"), F.transform(mine, _candidate).alias("candidates"))
        return F.struct(F.concat(F.lit("supplier "), s.cast("string")), pool)

    pools = F.struct(F.map_from_entries(F.transform(suppliers, entry)).alias("pools"))
    docs = _parsed(_lines(spark, d), F.struct(F.col("order").cast("string").alias("week"), pools.alias("personalization")), documents.ISSUE_SCHEMA)
    return documents.pool_rows(docs).select("week", "pool_id", "page_id", big("target").alias("target"), big("pos").alias("pos"), "title", "work_id", big("rank").alias("rank"))


@query("s05_radar_rows", f"""WITH x AS (SELECT *, CASE l_suppkey % 4 WHEN 0 THEN 'popular_scan' WHEN 1 THEN 'popular_deep' WHEN 2 THEN 'hd1' ELSE 'hd2' END AS pool_id FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS week, pool_id, count(*) OVER p AS target, row_number() OVER (p ORDER BY {_BY}) - 1 AS pos, '"Part" ' || l_partkey AS title, CAST(l_quantity AS BIGINT) AS rank FROM x WINDOW p AS (PARTITION BY l_orderkey, pool_id)""")
def s05(spark, d):
    """A radar an order, its lines in the four pools by supplier; pools without lines are absent."""

    def named(k: int, name: str) -> Column:
        mine = F.filter("lines", lambda x: x["l_suppkey"] % 4 == k)
        return F.when(F.size(mine) > 0, F.struct(F.size(mine).alias("target"), F.transform(mine, _candidate).alias("candidates"))).alias(name)

    pools = [named(k, name) for k, name in enumerate(("popular_scan", "popular_deep", "hd1", "hd2"))]
    docs = _parsed(_lines(spark, d), F.struct(F.col("order").cast("string").alias("week"), *pools), documents.RADAR_SCHEMA)
    return documents.radar_rows(docs).select("week", "pool_id", big("target").alias("target"), big("pos").alias("pos"), "title", big("rank").alias("rank"))


@query("s06_link_rows", r"""SELECT CAST(page_id AS VARCHAR) || ' ' || coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '?') AS title, kind, url FROM (
SELECT page_id, html, 'page' AS kind, url FROM pages WHERE url IS NOT NULL UNION ALL SELECT page_id, html, 'site', regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) FROM pages WHERE regexp_matches(url, '^[a-z]+://'))""")
def s06(spark, d):
    """A registry a page: its title, with its id, to its URL and its site."""
    p = table(spark, d, "pages")
    title = F.coalesce(F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")), F.lit("?"))
    site = F.nullif(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.lit(""))
    kinds = F.map_filter(F.create_map(F.lit("page"), "url", F.lit("site"), site), lambda _, v: v.isNotNull())
    docs = _parsed(p, F.struct(F.create_map(F.concat_ws(" ", F.col("page_id").cast("string"), title), kinds).alias("links")), "links map<string,map<string,string>>")
    return documents.link_rows(docs)


@query("s08_dossier_rows", """WITH x AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'pending' END AS list FROM lineitem)
SELECT l_suppkey AS dossier, list, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, count(*) - 1 AS last_pos, min(l_partkey) AS first_part FROM x GROUP BY ALL""")
def s08(spark, d):
    """A dossier file a supplier with three lists of its lines, sorted by part; each list is known by its file and name."""
    flag, lists = F.col("l_returnflag"), ["accepted", "returned", "pending"]
    entry = F.struct(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"))
    of = {"accepted": flag == "A", "returned": flag == "R", "pending": ~flag.isin("A", "R")}
    docs = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("dossier")).agg(*[F.sort_array(F.collect_list(F.when(of[x], entry))).alias(x) for x in lists])
    with Scratch(spark, "dossiers") as tmp:
        docs.write.partitionBy("dossier").option("maxRecordsPerFile", 1).json(f"{tmp.path}/dossiers")
        rows = documents.dossier_rows(spark, f"{tmp.path}/dossiers", lists, "struct<part:bigint,line:int>")
        dossier = F.regexp_extract("_file", r"/dossier=(\d+)/", 1).cast("long")
        out = rows.groupBy(dossier.alias("dossier"), F.col("_key").alias("list")).agg(F.count("*").alias("n"), F.sum("line").alias("lines"), F.max("_pos").cast("long").alias("last_pos"), F.min_by("part", "_pos").alias("first_part"))
        return staged(out, "dossier-rows")


#: A step of the order of a page, in SQL: times of a broadcast day with at most one turn.
_PLACED = """WITH RECURSIVE {0},
z AS (SELECT capture, i, m, CASE WHEN m < {1} THEN 'first_time' END AS error, CASE WHEN m < {1} THEN -1 ELSE m END AS previous, 0 AS turns, 0 AS day FROM r WHERE i = 0
 UNION ALL SELECT capture, i, m, error, CASE WHEN error IS NULL THEN m ELSE previous END, turns, CASE WHEN back AND error IS NULL THEN 1 ELSE day END FROM (SELECT *, CASE WHEN back AND turns > 1 THEN 'second_rollover' WHEN back AND (m >= {2} OR previous < 1080) THEN 'implausible_order' END AS error
   FROM (SELECT r.capture, r.i, r.m, z.previous, z.day, r.m < z.previous AS back, z.turns + CASE WHEN r.m < z.previous THEN 1 ELSE 0 END AS turns FROM z JOIN r ON r.capture = z.capture AND r.i = z.i + 1)))"""
_GUIDE = _PLACED.format("""e AS (SELECT *, user_id || ' ' || event_type || ' ' || CAST(CAST(ts - INTERVAL 12 HOUR AS DATE) AS VARCHAR) AS capture, CAST(ts - INTERVAL 12 HOUR AS DATE) AS printed, hour(ts) * 60 + minute(ts) AS m FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY capture) AS n FROM e)""", 300, 360)


@query("s09_list_layout", f"""{_GUIDE}
SELECT capture AS capture_id, event_type AS channel, CAST(i AS INTEGER) AS "row", printed + z.day AS date, CAST(m AS BIGINT) AS start_min, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'Événement ' || event_id || ' & ' || props END AS title, CASE WHEN event_id % 3 = 0 THEN 'suite' ELSE '' END AS subtitle,
 CASE WHEN event_id % 13 <> 0 THEN 'https://guide.example/fr/videos/' || event_id END AS link, coalesce(z.error, CASE WHEN event_id % 13 = 0 THEN 'link_missing' WHEN event_id % 11 = 0 THEN 'title_missing' END) AS error
FROM r JOIN z USING (capture, i, m) WHERE user_id % 7 <> 0 AND NOT (user_id % 5 = 0 AND i = n - 1) UNION ALL
SELECT capture, event_type, NULL, printed, NULL, NULL, NULL, NULL, CASE WHEN user_id % 7 = 0 THEN 'canonical_mismatch' WHEN n = 1 THEN 'no_rows' ELSE 'truncated_rows ' || n - 1 || ' of ' || n END FROM r WHERE i = 0 AND (user_id % 7 = 0 OR user_id % 5 = 0)""")
def s09(spark, d):
    """A capture the events of a user and type from noon to noon, in the broadcaster's layout; some pages are another's, some are cut in their last item."""
    e, ts, text = table(spark, d, "events"), F.col("ts"), lambda c: F.col(c).cast("string")
    title = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("Événement "), text("event_id"), F.lit(" &amp; "), F.replace("props", F.lit('"'), F.lit("&quot;"))))
    link = F.when(F.col("event_id") % 13 == 0, "/de/videos/").otherwise("/fr/videos/")
    item = F.concat(
        F.lit('<li class="x" data-testid="tsguide-itm">\n<a href="/fr/other"></a><span class="t">'), clock_text(F.hour(ts) * 60 + F.minute(ts)), F.lit('</span><a data-testid="ts-tsItemLink" href="'), link, text("event_id"), F.lit('"><h3 class="h" data-testid="ts-tsTitle"><b>'),
        title, F.lit("</b></h3>"), F.when(F.col("event_id") % 3 == 0, '<p data-testid="ts-tsSubtitle">suite</p>').otherwise(""), F.lit("</a></li>\n"),
    )
    printed = (ts - F.expr("INTERVAL 12 HOURS")).cast("date")
    cap = e.groupBy("user_id", F.col("event_type").alias("channel"), printed.alias("date")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", item.alias("h")))).alias("i"))
    key = F.concat_ws(" ", text("user_id"), "channel", text("date"))
    url = F.concat(F.lit("https://guide.example/"), F.replace(key, F.lit(" "), F.lit("/")))
    whole = F.array_join(F.transform("i", lambda x: x["h"]), "")
    whole = F.when(F.col("user_id") % 5 == 0, F.left(whole, F.length(whole) - 6)).otherwise(whole)
    body = F.concat(F.lit("<html><head><link rel='stylesheet' href='/x'><link href=\""), url, F.when(F.col("user_id") % 7 == 0, "/other").otherwise(""), F.lit('" rel="canonical"></head><ul>'), whole)
    return captures.guide_list(cap.select(key.alias("capture_id"), url.alias("url"), "channel", "date", body.alias("body")), captures.BROADCASTER_GUIDE).withColumn("start_min", big("start_min"))


_PORTAL = _PLACED.format("""e AS (SELECT *, user_id || ' ' || CAST(CAST(ts - INTERVAL 6 HOUR AS DATE) AS VARCHAR) AS capture, CAST(ts - INTERVAL 6 HOUR AS DATE) AS printed, hour(ts) * 60 + minute(ts) AS m0 FROM events),
r AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN 400 ELSE m0 END AS m, row_number() OVER (PARTITION BY capture ORDER BY ts, event_id) - 1 AS i FROM e)""", 0, 480)


@query("s09_portal_layout", f"""{_PORTAL}
SELECT capture AS capture_id, 'TF1' AS channel, CAST(i AS INTEGER) AS "row", printed + z.day AS date, CAST(m AS BIGINT) AS start_min, event_type AS title, CASE WHEN event_id % 4 = 0 THEN 'S' || event_id ELSE '' END AS subtitle, CASE WHEN event_id % 2 = 0 THEN 'https://portal.example/p/' || event_id END AS link, z.error
FROM r JOIN z USING (capture, i, m) WHERE user_id % 6 <> 0 UNION ALL SELECT DISTINCT capture, 'TF1', CAST(NULL AS INTEGER), printed, CAST(NULL AS BIGINT), NULL, NULL, NULL, CASE WHEN user_id % 12 = 0 THEN 'unavailable_page' ELSE 'date_mismatch' END FROM r WHERE user_id % 6 = 0""")
def s09_portal(spark, d):
    """A capture the events of a user from six to six, in the portal's layout, whose title names the day; some pages are a day off, or a challenge."""
    e, ts, text = table(spark, d, "events"), F.col("ts"), lambda c: F.col(c).cast("string")
    time = F.when(F.col("event_id") % 17 == 0, 400).otherwise(F.hour(ts) * 60 + F.minute(ts))
    item = F.concat(
        F.lit('<li class="tvgrid-broadcast__item">'), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('<a href="/p/'), text("event_id"), F.lit('">'))).otherwise('<a href="javascript:x">'), F.lit('</a><div class="tvgrid-broadcast__details-time"> '), clock_text(time), F.lit(' </div><div class="tvgrid-broadcast__details-title">'),
        F.col("event_type"), F.lit("</div>"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('<div class="tvgrid-broadcast__details-season">S'), text("event_id"), F.lit("</div>"))).otherwise(""), F.lit("</li>"),
    )
    printed = (ts - F.expr("INTERVAL 6 HOURS")).cast("date")
    cap = e.groupBy("user_id", printed.alias("date")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", item.alias("h")))).alias("i"))
    key = F.concat_ws(" ", text("user_id"), text("date"))
    url = F.concat(F.lit("https://portal.example/tf1/"), F.replace(key, F.lit(" "), F.lit("/")))
    named = F.date_add("date", F.when(F.col("user_id") % 6 == 0, 1).otherwise(0))
    first = F.when(F.dayofmonth(named) == 1, "1er").otherwise(F.dayofmonth(named).cast("string"))
    month = F.element_at(F.array(*map(F.lit, FRENCH_MONTHS)), F.month(named))
    heading = F.concat(F.lit("<title>Programme TF1 "), F.initcap(weekday_name(named)), F.lit(" "), first, F.lit(" "), month, F.lit(" | Guide</title>"))
    body = F.concat(F.lit("<head>"), heading, F.lit('<link rel="canonical" href="'), F.replace(url, F.lit("/tf1/"), F.lit("/TF1/")), F.lit('"></head>'), F.when(F.col("user_id") % 12 == 0, "<p>Access denied</p>").otherwise(""), F.array_join(F.transform("i", lambda x: x["h"]), "\n"))
    return captures.guide_list(cap.select(key.alias("capture_id"), url.alias("url"), F.lit("TF1").alias("channel"), "date", body.alias("body")), captures.PORTAL_GUIDE).withColumn("start_min", big("start_min"))


@query("s01_works", """WITH p AS (SELECT p_partkey, p_name, p_brand, p_size, p_partkey % 10 = 3 AS cut, p_partkey % 10 = 6 AS nameless FROM part)
SELECT 'w' || p_partkey AS id, p_name AS title, p_brand AS director, CAST(1950 + p_size AS VARCHAR) AS year, 2 AS n_links, NULL AS text FROM p WHERE NOT cut AND NOT nameless
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'w' || p_partkey FROM p WHERE cut UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, p_name FROM p WHERE nameless UNION ALL SELECT 'counts', NULL, NULL, CAST(count(*) FILTER (NOT cut AND NOT nameless) AS VARCHAR), count(*) FILTER (cut OR nameless), NULL FROM p""")
def s01(spark, d):
    """Parts as a catalogue of JSON lines, some cut short and some without an id; what is kept, what is rejected, and how many of each."""
    p = table(spark, d, "part")
    key, k = F.concat(F.lit("w"), F.col("p_partkey").cast("string")), F.col("p_partkey") % 10
    doc = F.to_json(F.struct(F.when(k != 6, key).alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("director"), (F.col("p_size") + 1950).cast("string").alias("year"), F.create_map(F.lit("imdb"), key, F.lit("sc"), key).alias("links")))
    line = F.when(k == 3, F.left(doc, F.length(doc) - 8)).when(k == 9, F.concat(doc, F.lit("\n  "))).otherwise(doc)
    with Scratch(spark, "works") as tmp:
        p.select(line.alias("value")).write.text(f"{tmp.path}/in")
        n = documents.quarantine_works(spark, f"{tmp.path}/in", f"{tmp.path}/out")
        none = F.lit(None).cast("string")
        kept = documents.kept_works(spark, f"{tmp.path}/out").select("id", "title", "director", "year", F.size("links").cast("long").alias("n_links"), none.alias("text"))
        bad = documents.rejected_works(spark, f"{tmp.path}/out").where("line >= 0")
        text = F.coalesce(F.nullif(F.regexp_extract("text", r'"id":"(w\d+)"', 1), F.lit("")), F.regexp_extract("text", r'"title":"([^"]*)"', 1))
        bad = bad.select(none.alias("id"), none.alias("title"), none.alias("director"), none.alias("year"), F.lit(None).cast("long").alias("n_links"), text.alias("text"))
        counts = spark.range(1).select(F.lit("counts").alias("id"), none.alias("title"), none.alias("director"), F.lit(str(n["works"])).alias("year"), F.lit(n["rejected"]).cast("long").alias("n_links"), none.alias("text"))
        return staged(kept.unionByName(bad).unionByName(counts), "works")


@query("s10_offset_layout", """WITH o AS (SELECT *, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS instant FROM orders), p AS (SELECT *, timezone('Europe/Paris', timezone('UTC', instant)) AS local FROM o)
SELECT o_custkey AS capture_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, CAST(local AS DATE) AS date, CAST(hour(local) * 60 + minute(local) AS BIGINT) AS start_min, o_orderpriority || ' < ' || o_orderkey AS title FROM p""")
def s10(spark, d):
    """A capture the orders of a customer, with offsets of two and of no hours, in summer and winter."""
    k = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(k % 1440).cast("int"))
    stamp = lambda t, z: F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(z))
    start = F.when(k % 2 == 0, stamp(at, "+00:00")).otherwise(stamp(at + F.expr("INTERVAL 2 HOURS"), "+02:00"))
    html = F.concat(F.lit('<article class="x" data-start="'), start, F.lit('">\n<h3 class="t">'), F.col("o_orderpriority"), F.lit(" &lt; <i>"), k.cast("string"), F.lit("</i></h3></article>\n"))
    cap = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("capture_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", html.alias("h")))).alias("i"))
    rows = captures.offset_layout(cap.select("capture_id", F.lit("c").alias("channel"), F.array_join(F.transform("i", lambda x: x["h"]), "").alias("body")))
    return rows.select("capture_id", big("pos").alias("pos"), "date", big("start_min").alias("start_min"), "title")


@query("s11_xml_layout", f"""SELECT l_orderkey AS capture_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_BY}) - 1 AS pos, CAST(l_shipdate AS DATE) AS date, l_partkey % 1440 AS start_min, 'A & B <' || l_suppkey || '>' AS title FROM lineitem""")
def s11(spark, d):
    """A grid an order, a broadcast a line."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    one = lambda x: tag("diffusion", F.concat(tag("date", x["l_shipdate"].cast("string")), tag("heure", clock_text(x["l_partkey"] % 1440)), tag("titre", F.concat(F.lit(" A &amp; B &lt;"), x["l_suppkey"].cast("string"), F.lit("&gt; ")))))
    body = tag("grille", F.array_join(F.transform("lines", one), ""))
    rows = captures.xml_layout(_lines(spark, d).select(F.col("order").alias("capture_id"), F.lit("c").alias("channel"), body.alias("body")))
    return rows.select("capture_id", big("pos").alias("pos"), "date", big("start_min").alias("start_min"), "title")


def _json_captures(spark, d) -> DataFrame:
    """Pages of up to three lines of an order."""
    one = lambda x: F.struct(F.concat(F.lit('"'), x["l_partkey"].cast("string")).alias("title"), clock_text(x["l_suppkey"] % 1440).alias("start"))
    n = F.size("lines")
    each = _lines(spark, d).select("order", n.alias("n"), F.ceil(n / 3).alias("pages"), F.explode(F.sequence(F.lit(1), F.ceil(n / 3).cast("int"))).alias("page"), "lines")
    body = F.to_json(F.struct("page", F.col("pages").alias("total_pages"), F.col("n").alias("total_products"), F.transform(F.slice("lines", F.col("page") * 3 - 2, F.lit(3)), one).alias("products")))
    return each.select(F.concat_ws(".", F.col("order").cast("string"), F.col("page").cast("string")).alias("capture_id"), F.lit("c").alias("channel"), F.lit("2024-01-01").cast("date").alias("date"), body.alias("body"))


_JSON = f"WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_BY}) - 1 AS r, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem)"


@query("s12_json_rows", f"""{_JSON} SELECT l_orderkey || '.' || (r // 3 + 1) AS capture_id, r % 3 AS pos, l_suppkey % 1440 AS start_min, '"' || l_partkey AS title FROM x""")
def s12(spark, d):
    rows = captures.json_layout(_json_captures(spark, d))[0]
    return rows.select("capture_id", big("pos").alias("pos"), big("start_min").alias("start_min"), "title")


@query("s12_json_pages", f"""{_JSON} SELECT l_orderkey || '.' || (r // 3 + 1) AS capture_id, r // 3 + 1 AS page, CAST(ceil(c / 3.0) AS BIGINT) AS total_pages, c AS total_products, count(*) AS n FROM x GROUP BY ALL""")
def s12_pages(spark, d):
    pages = captures.json_layout(_json_captures(spark, d))[1]
    return pages.select("capture_id", *[big(c).alias(c) for c in ("page", "total_pages", "total_products", "n")])


@query("s20_watch_list_csv", """SELECT '"' || conv_id || '";"' || turn || '";"' || coalesce(role, '') || '";"' || replace(coalesce(text, ''), '"', '""') || '"' AS entry FROM conversations""")
def s20(spark, d):
    """Conversation turns as a watch list: exported, and read again as text; the header goes (Spark passes over its byte-order mark). Texts of several lines are read as written."""
    with Scratch(spark, "csv") as tmp:
        sinks.watch_list_csv(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), f"{tmp.path}/list")
        whole = spark.read.option("lineSep", '"\n').text(f"{tmp.path}/list").where(F.col("value") != '"conv_id";"turn";"role";"text')
        # each record ends in a quote and a line end, of which neither is left
        return staged(whole.select(F.concat("value", F.lit('"')).alias("entry")), "watch-list")


@query("s21_report", """SELECT 'row' AS kind, event_type AS channel, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'summary', NULL, count(*) FROM events""")
def s21(spark, d):
    """A job's rows and its summary, written and read again."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("channel"))
    with Scratch(spark, "report") as tmp:
        sinks.report(e, f"{tmp.path}/job", e.agg(F.count("*").alias("n")))
        rows = spark.read.parquet(f"{tmp.path}/job/rows").groupBy("channel").agg(F.count("*").alias("n"))
        total = spark.read.parquet(f"{tmp.path}/job/summary").select(F.lit("summary").alias("kind"), F.lit(None).cast("string").alias("channel"), "n")
        return staged(rows.select(F.lit("row").alias("kind"), "channel", "n").union(total), "report")


#: Events as what users do to titles: what is seen, what no longer, what is turned over, and states that they set.
_ACTION = """CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'unseen' WHEN 'purchase' THEN 'toggle' WHEN 'signup' THEN 'a-recuperer' ELSE 'recupere' END"""
_REPLAY = f"""WITH RECURSIVE a AS (SELECT user_id, 'k' || CAST(props->>'$.k' AS INTEGER) % 20 AS k, ts, event_id, {_ACTION} AS action FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS i FROM a WHERE {{0}}),
s AS (SELECT user_id, k, i, ts, event_id, action IN ('seen', 'toggle') AS seen, CASE WHEN action IN ('seen', 'unseen', 'toggle') THEN NULL ELSE action END AS status FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.k, o.i, o.ts, o.event_id, CASE o.action WHEN 'seen' THEN true WHEN 'toggle' THEN NOT s.seen ELSE false END, CASE WHEN o.action IN ('seen', 'unseen', 'toggle') THEN s.status ELSE o.action END
  FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k AND o.i = s.i + 1)"""


def _actions(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("user_id", F.concat(F.lit("k"), (k % 20).cast("string")).alias("k"), "ts", "event_id", F.expr(_ACTION).alias("action"))


@query("t02_seen_state", _REPLAY.format("true") + """ SELECT user_id, k, seen, CASE WHEN seen THEN 'vu' ELSE status END AS status, CASE WHEN seen THEN status END AS previous_status FROM (SELECT *, i = max(i) OVER (PARTITION BY user_id, k) AS last FROM s) WHERE last""")
def t02(spark, d):
    """The status after all actions, from counts; the SQL replays them one by one."""
    return personal.seen_status(_actions(table(spark, d, "events")))


@query("t02_seen_stream", _REPLAY.format("ts < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR") + """ SELECT user_id, k, event_id, CASE WHEN seen THEN 'vu' ELSE status END AS status, CASE WHEN seen THEN status END AS previous_status FROM s""")
def t02_stream(spark, d):
    """Every change of status as a stream, until the watermark."""
    return _streamed(spark, d, lambda e: jobs.seen_state(_actions(e))).drop("ts_us")


@query("t06_capture_ages", """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS source_key, ts, event_type <> 'error' AS ok FROM events), g AS (SELECT source_key, ts AS t, lead(ts) OVER (PARTITION BY source_key ORDER BY ts) AS n FROM c WHERE ok),
f AS (SELECT g.source_key, t, coalesce(n, TIMESTAMP '9999-01-01') AS n, coalesce(min(c.ts), TIMESTAMP '9999-01-01') AS f FROM g LEFT JOIN c ON c.source_key = g.source_key AND NOT c.ok AND c.ts > t AND (n IS NULL OR c.ts < n) GROUP BY ALL),
x AS (SELECT source_key, t AS "at", 'fresh' AS state FROM f UNION ALL SELECT source_key, t + INTERVAL 12 HOUR, 'expired' FROM f WHERE t + INTERVAL 12 HOUR <= least(f, n)
  UNION ALL SELECT source_key, least(f, t + INTERVAL 24 HOUR), 'stale' FROM f WHERE least(f, t + INTERVAL 24 HOUR) <= n UNION ALL SELECT source_key, min(ts), 'failed' FROM c WHERE NOT ok AND NOT EXISTS (SELECT 1 FROM g WHERE g.source_key = c.source_key AND t < c.ts) GROUP BY source_key)
SELECT * FROM x WHERE "at" < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def t06(spark, d):
    """Users as sources, their events as captures of which errors are refreshes that fail: all changes of state until the watermark."""
    captured = lambda e: e.select(F.col("user_id").cast("string").alias("source_key"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("capture_id"), (F.col("event_type") != "error").alias("ok"))
    out = _streamed(spark, d, lambda e: jobs.capture_ages(captured(e), ttl_hours=12, stale_hours=24))
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


def _observed(e: DataFrame) -> DataFrame:
    """Events as observations: four channels with hourly slots, five titles in two spellings, three pages a day."""
    k, text = F.get_json_object("props", "$.k").cast("int"), lambda c: c.cast("string")
    title = F.concat(F.when(k % 2 == 0, F.lit("TITRE ")).otherwise(F.lit("Titre-")), text(k % 5))
    status = F.when(F.col("event_type") == "error", "stale").when(F.col("event_type") == "signup", "partial").otherwise("parsed")
    return e.select(
        F.col("ts").cast("date").alias("date"), F.date_format("ts", "HH:00").alias("start"), F.concat(F.lit("Chaîne "), text(F.col("user_id") % 4)).alias("channel"), title.alias("title"),
        F.concat(F.lit("https://guide.example/"), text(k % 3)).alias("source_url"), status.alias("status"), F.struct("ts", "event_id").alias("pos"),
    )


@query("t05_import", """WITH o AS (SELECT CAST(ts AS DATE) AS date, strftime(ts, '%H:00') AS start, 'Chaîne ' || user_id % 4 AS channel, CASE WHEN CAST(props->>'$.k' AS INTEGER) % 2 = 0 THEN 'TITRE ' ELSE 'Titre-' END || CAST(props->>'$.k' AS INTEGER) % 5 AS title, CAST(props->>'$.k' AS INTEGER) % 5 AS t,
  'https://guide.example/' || CAST(props->>'$.k' AS INTEGER) % 3 AS source_url, event_type = 'error' AS stale, ts, event_id FROM events),
m AS (SELECT *, bool_and(stale) OVER (PARTITION BY source_url, channel, date, start, t) AS all_stale FROM o),
r AS (SELECT *, CASE WHEN all_stale THEN 'stale_source_after_failed_refresh' WHEN date NOT BETWEEN DATE '2024-01-06' AND DATE '2024-01-26' THEN 'outside_the_week' END AS reason FROM m),
w AS (SELECT *, row_number() OVER s AS i, first_value(t) OVER s AS t1, first_value(title) OVER s AS title1 FROM r WHERE reason IS NULL WINDOW s AS (PARTITION BY date, start, channel ORDER BY ts, event_id))
SELECT date, start, channel, title, source_url, 'excluded' AS outcome, reason, NULL AS saved_titles FROM r WHERE reason IS NOT NULL UNION ALL
SELECT date, start, channel, title, source_url, CASE WHEN i = 1 THEN 'added' WHEN t = t1 THEN 'duplicate' ELSE 'conflict' END, NULL, CASE WHEN t <> t1 THEN title1 END FROM w""")
def t05(spark, d):
    """The events as a stream in two triggers, before and after a day in mid-month, and the four tables that it leaves."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    with Scratch(spark, "import") as tmp:
        for k, part in enumerate((early, ~early)):
            events.where(part).write.parquet(f"{tmp.path}/in/{k}")
            stream = spark.readStream.schema(events.schema).parquet(f"{tmp.path}/in/*")
            tables.ingest(stream, f"{tmp.path}/imported", f"{tmp.path}/checkpoint", _observed, F.lit("2024-01-06").cast("date"), days=21).awaitTermination()
        out = [tables.committed(spark, f"{tmp.path}/imported", name, tables.IMPORTED).withColumn("outcome", F.lit(name)) for name in tables.OUTCOMES]
        every = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
        return staged(every.drop("batch").withColumn("saved_titles", F.array_join("saved_titles", "|")), "imported")


def _streamed(spark, d, job) -> DataFrame:
    """What a streaming job emits over the events, once through."""
    schema = table(spark, d, "events").schema
    with Scratch(spark, "stream") as tmp:
        # a stream takes a folder or a pattern, and the table may be a file
        events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
        out = job(events.withColumn("ts", F.col("ts").cast("timestamp")))
        run = out.writeStream.format("parquet").option("path", f"{tmp.path}/out").option("checkpointLocation", f"{tmp.path}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
        return staged(spark.read.schema(out.schema).parquet(f"{tmp.path}/out"), "emitted")


@query("t01_recent_topics", """SELECT CAST(user_id AS VARCHAR) AS k, max(ts) AS "at", arg_max(event_type || ' ' || props, ts) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:10:00' GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-19 12:00:00'""")
def t01(spark, d):
    """Users as topics, as a stream; what is current at an instant in the events."""
    now = "2024-01-20 12:00:00"
    topics = lambda e: e.select(F.col("user_id").alias("topic_id"), F.col("ts").alias("activity_at"), F.concat_ws(" ", "event_type", "props").alias("title"))
    out = jobs.current(_streamed(spark, d, lambda e: jobs.recent_topics(topics(e), 24, now)), F.lit(now).cast("timestamp"), 24)
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("t01_topic_upserts", """SELECT CAST(user_id AS VARCHAR) AS k, max(ts) AS "at", arg_max(event_type || ' ' || props, ts) AS value FROM events GROUP BY user_id""")
def t01_upserts(spark, d):
    """The newest activity of every topic, as the table that the stream keeps by upserts in two triggers."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    topics = lambda e: e.select(F.col("user_id").cast("string").alias("k"), F.col("ts").alias("at"), F.concat_ws(" ", "event_type", "props").alias("value"))
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    with Scratch(spark, "upserts") as tmp:
        for k, part in enumerate((early, ~early)):
            events.where(part).write.parquet(f"{tmp.path}/in/{k}")
            stream = spark.readStream.schema(events.schema).parquet(f"{tmp.path}/in/*")
            tables.upsert(topics(stream), f"{tmp.path}/topics", f"{tmp.path}/checkpoint", ["k"], ["at"], buckets=8).awaitTermination()
        served = tables.upserted(spark, f"{tmp.path}/topics", "k string, `at` timestamp, value string")
        return staged(served, "topics").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("t03_match_cache", """WITH g AS (SELECT user_id, max(ts) AS "at", arg_max(event_id, ts) AS id, arg_max(event_type, ts) AS latest FROM events WHERE ts <= TIMESTAMP '2024-01-31 00:10:00' GROUP BY user_id) SELECT CAST(user_id AS VARCHAR) AS k, "at", CAST(id AS VARCHAR) AS value FROM g WHERE latest <> 'error' AND "at" >= TIMESTAMP '2024-01-29 00:00:00'""")
def t03(spark, d):
    """Events as searches, as a stream: an error is one without a match."""
    found = F.col("event_type") != "error"
    searches = lambda e: e.select(F.col("user_id").alias("k"), "ts", F.when(found, F.col("event_id")).alias("match_id"), found.alias("found"))
    out = jobs.current(_streamed(spark, d, lambda e: jobs.match_cache(searches(e), 48)), F.lit("2024-01-31 00:00:00").cast("timestamp"), 48)
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))
