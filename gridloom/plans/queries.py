"""Registered queries over whole driver tables, each beside its DuckDB SQL. Names begin with the operators they apply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import calendar, keys, parse, predicates
from gridloom.operators import audits, consensus, freshness, identity, personal, planning, readers, schedule
from gridloom.plans.frames import LINKS, OCC, POOL, SCHED, WORKS, line_links, occurrences, pool, table, works
from gridloom.plans.frames import schedule as programme
from gridloom.sources import captures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEY = "trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', ' ', 'g'))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def big(c):
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


# Freshness: the flagship first.


@query("a15_fresh_ratio", f"""WITH {OCC}, t AS (SELECT DISTINCT week, title_key FROM occ), seq AS (SELECT week, row_number() OVER (ORDER BY "from") AS issue_seq FROM (SELECT DISTINCT week, "from" FROM occ)),
r AS (SELECT t.week, issue_seq, title_key, lag(issue_seq) OVER (PARTITION BY title_key ORDER BY issue_seq) AS prev FROM t JOIN seq USING (week))
SELECT week, count(*) AS n_titles, count(*) FILTER (prev IS NULL OR issue_seq - prev > 4) AS n_new, count(*) FILTER (prev = issue_seq - 1) AS n_repeat,
 CAST(floor(100.0 * count(*) FILTER (prev IS NULL OR issue_seq - prev > 4) / count(*) + 0.5) AS BIGINT) AS fresh_pct FROM r GROUP BY week""")
def a15(spark, d):
    occ = occurrences(spark, d)
    return freshness.fresh_ratio(occ, freshness.issue_sequence(occ), 4).drop("issue_seq")


@query("w11_j18_last_exposure", f"""WITH {OCC}, t AS (SELECT DISTINCT week, title_key FROM occ), seq AS (SELECT week, row_number() OVER (ORDER BY "from") AS issue_seq FROM (SELECT DISTINCT week, "from" FROM occ)),
r AS (SELECT t.week, issue_seq, title_key, lag(issue_seq) OVER (PARTITION BY title_key ORDER BY issue_seq) AS prev FROM t JOIN seq USING (week))
SELECT week, title_key, issue_seq, CASE WHEN issue_seq - prev <= 2 THEN prev END AS last_seq FROM r""")
def w11(spark, d):
    occ = occurrences(spark, d)
    return freshness.repeats(occ, freshness.issue_sequence(occ), 2).select("week", "title_key", big("issue_seq").alias("issue_seq"), big("last_seq").alias("last_seq"))


@query("u04_repeats_of_previous", f"""WITH {OCC}, seq AS (SELECT week, row_number() OVER (ORDER BY "from") AS issue_seq FROM (SELECT DISTINCT week, "from" FROM occ)), n AS (SELECT DISTINCT issue_seq, title_key FROM occ JOIN seq USING (week))
SELECT a.issue_seq, a.title_key FROM n a JOIN n b ON a.title_key = b.title_key AND b.issue_seq = a.issue_seq - 1 WHERE a.title_key NOT LIKE 'red%'""")
def u04(spark, d):
    occ = occurrences(spark, d)
    seq = freshness.issue_sequence(occ)
    named = occ.select("week", "title_key").distinct().join(F.broadcast(seq.select("week", "issue_seq")), "week")  # one row a week
    return freshness.repeats_of_previous(occ, seq, named.where("title_key LIKE 'red%'")).select(big("issue_seq").alias("issue_seq"), "title_key")


@query("a16_exposure", f"""WITH {OCC}, e AS (SELECT title_key, week, CASE WHEN qty >= 30 THEN 'public' WHEN qty >= 10 THEN 'reserve' ELSE 'occurrence' END AS scope FROM occ)
SELECT title_key, week, string_agg(DISTINCT scope, ',' ORDER BY scope) AS scopes FROM e GROUP BY ALL""")
def a16(spark, d):
    occ = occurrences(spark, d)
    return freshness.exposure(occ.where("qty >= 30"), occ.where("qty >= 10 AND qty < 30"), occ.where("qty < 10"))


@query("u03_core_titles", f"""WITH {OCC}, {POOL}, p AS (SELECT week, title_key, o.pool_id, rank, target FROM occ o JOIN pool q ON o.pool_id = q.pool_id AND o.id = q.work_id)
SELECT week, title_key, 'public' AS core FROM p WHERE rank <= target UNION SELECT week, title_key, 'public' FROM occ WHERE qty > 48 UNION SELECT week, title_key, 'public' FROM occ WHERE qty < 3 UNION ALL SELECT DISTINCT week, title_key, 'reserve' FROM p WHERE rank > target""")
def u03(spark, d):
    occ = occurrences(spark, d)
    p = occ.join(pool(spark, d).withColumnRenamed("work_id", "id"), ["pool_id", "id"])
    return freshness.core_titles(occ.where("qty > 48"), occ.where("qty < 3"), p, occ)


@query("w14_a42_radar_reconcile", """WITH r AS (SELECT event_id AS row_id, CASE WHEN user_id % 10 <> 0 THEN user_id END AS work_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS precedence, CAST(event_id % 50 AS INTEGER) AS rank, CASE WHEN user_id % 17 = 0 AND event_id % 2 = 0 THEN 'hd' WHEN user_id % 17 = 0 THEN 'sd' END AS version FROM events),
v AS (SELECT work_id, count(DISTINCT version) AS v, min(precedence) AS p FROM r GROUP BY work_id), o AS (SELECT r.*, v.v, v.p, row_number() OVER (PARTITION BY r.work_id ORDER BY precedence, rank, row_id) AS n, first_value(row_id) OVER (PARTITION BY r.work_id ORDER BY precedence, rank, row_id) AS kept_at FROM r JOIN v ON r.work_id IS NOT DISTINCT FROM v.work_id)
SELECT row_id, CASE WHEN work_id IS NULL THEN row_id ELSE kept_at END AS kept_at, CASE WHEN work_id IS NULL THEN 'keep_unresolved' WHEN v > 1 THEN 'hold_version_conflict' WHEN n = 1 THEN 'keep' WHEN p = precedence THEN 'remove_same_pool' ELSE 'remove_earlier_pool' END AS decision FROM o""")
def w14(spark, d):
    e = table(spark, d, "events")
    pos = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    version = F.when((F.col("user_id") % 17 == 0) & (F.col("event_id") % 2 == 0), "hd").when(F.col("user_id") % 17 == 0, "sd")
    rows = e.select(F.col("event_id").alias("row_id"), F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("work_id"), pos.alias("precedence"), (F.col("event_id") % 50).cast("int").alias("rank"), version.alias("version"))
    return freshness.radar_reconcile(rows).select("row_id", "kept_at", "decision")


@query("a11_section_depth", f"WITH {POOL} SELECT pool_id AS section, count(*) AS cards, count(DISTINCT work_id) AS works, CAST(sum(CASE WHEN rank > target THEN 1 ELSE 0 END) AS BIGINT) AS depth FROM pool GROUP BY ALL")
def a11(spark, d):
    return freshness.lower_depth(pool(spark, d).withColumnRenamed("pool_id", "section"))


@query("a41_radar_deficits", """WITH g AS (SELECT event_type AS pool, count(DISTINCT user_id) AS works FROM events GROUP BY 1), n AS (SELECT * FROM (VALUES ('view', 100), ('purchase', 1000000), ('absent', 7)) t(pool, least))
SELECT pool, coalesce(works, 0) AS works, CAST(greatest(0, least - coalesce(works, 0)) AS BIGINT) AS deficit FROM n LEFT JOIN g USING (pool)""")
def a41(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("pool"), F.col("user_id").alias("work_id"))
    return freshness.radar_deficits(rows, {"view": 100, "purchase": 1_000_000, "absent": 7}).select("pool", big("works").alias("works"), big("deficit").alias("deficit"))


# Keys and text.


@query("p01_p05_text_keys", r"""SELECT doc_id, md5(strip_accents(lower(text))) AS search_md5, md5(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))) AS fresh_md5,
md5(trim(regexp_replace(replace(replace(lower(strip_accents(text)), 'œ', 'oe'), 'æ', 'ae'), '[^a-z0-9]+', ' ', 'g'))) AS match_md5,
md5(replace(trim(regexp_replace(replace(replace(lower(strip_accents(text)), 'œ', 'oe'), 'æ', 'ae'), '[^a-z0-9]+', ' ', 'g')), ' ', '')) AS compact_md5, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS exact_md5 FROM documents""")
def text_keys(spark, d):
    t = F.col("text")
    m = lambda c, n: F.md5(c).alias(n)
    return table(spark, d, "documents").select("doc_id", m(keys.search_key(t), "search_md5"), m(keys.fresh_key(t), "fresh_md5"), m(keys.match_key(t), "match_md5"), m(keys.compact_key(t), "compact_md5"), m(keys.exact_key(t), "exact_md5"))


@query("p06_p07_script_and_library_keys", r"""SELECT conv_id, turn, md5(trim(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]+', ' ', 'g'))) AS script_md5,
md5(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))) AS library_md5 FROM conversations""")
def script_keys(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(keys.script_key(F.col("text"))).alias("script_md5"), F.md5(keys.library_key(F.col("text"))).alias("library_md5"))


@query("p08_slugs_and_ids", f"WITH {WORKS} SELECT id, replace({KEY.format('title')}, ' ', '-') AS slug, replace({KEY.format('title')}, ' ', '-') || '-' || CAST(year AS VARCHAR) AS new_id FROM works")
def slugs(spark, d):
    return works(spark, d).select("id", keys.slug(F.col("title")).alias("slug"), keys.work_id(F.col("title"), F.col("year")).alias("new_id"))


#: Entities that the pages lack: each is decoded once, numbers that are no character are replaced, unknown names stay.
_MORE_ENTITIES = "<b>&#233;&#x1F600;</b>&#0;&#xD800;&#99999999999999999999;&Eacute;&hellip;&amp;lt;&#38;gt;&unknown;&AMP;&nbsp;&ldquo;x&rdquo; "
_DECODED = " é😀 ���É…&lt;&gt;&unknown;& “x”"


@query("p09_html_text", rf"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&middot;', '·'), '&copy;', '&©'), '&amp;', '&'), '&©', '&copy;'), '[\s\x{{a0}}]+', ' ', 'g')) || '{_DECODED}') AS text_md5 FROM pages""")
def html_texts(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(parse.html_text(F.concat("html", F.lit(_MORE_ENTITIES)))).alias("text_md5"))


@query("p10_p11_clock", f"""WITH {SCHED} SELECT row_id, CAST(start_min AS BIGINT) AS start_min, CAST(start_min // 60 AS VARCHAR) || ' h ' || lpad(CAST(start_min % 60 AS VARCHAR), 2, '0') AS label, start_min < 360 AS night, CASE WHEN start_min < 360 THEN date - 1 ELSE date END AS grid_date FROM sched""")
def clock(spark, d):
    s = programme(spark, d)
    text = F.format_string("%02d:%02d", F.floor(F.col("start_min") / 60).cast("int"), F.col("start_min") % 60)
    m = calendar.minutes(text)
    return s.select("row_id", big(m).alias("start_min"), calendar.duration_label(m).alias("label"), calendar.is_night(m).alias("night"), calendar.grid_date(F.col("date"), m).alias("grid_date"))


@query("p12_issue_calendar", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), s AS (SELECT day, day - CAST((isodow(day) + 1) % 7 AS INTEGER) AS sat FROM d)
SELECT day, sat, strftime(sat + 2, '%G-S%V') AS week, CASE WHEN sat = day THEN day ELSE sat + 7 END AS target, sat AS back, ['lundi','mardi','mercredi','jeudi','vendredi','samedi','dimanche'][isodow(day)] AS weekday FROM s""")
def issue_calendar(spark, d):
    day = F.col("day")
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().withColumn("sat", calendar.issue_from(day)).withColumn("week", calendar.week_of_saturday(F.col("sat")))
    return days.select("day", "sat", "week", calendar.target_saturday(day).alias("target"), calendar.saturday_of_week(F.col("week")).alias("back"), calendar.weekday_name(day).alias("weekday"))


@query("p13_paris_time", """SELECT event_id, CAST(timezone('Europe/Paris', timezone('UTC', ts)) AS DATE) AS day, CAST(hour(timezone('Europe/Paris', timezone('UTC', ts))) * 60 + minute(timezone('Europe/Paris', timezone('UTC', ts))) AS BIGINT) AS minute FROM events""")
def paris_time(spark, d):
    day, minute = calendar.paris(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", day.alias("day"), big(minute).alias("minute"))


@query("p14_p16_durations_years", """SELECT p_partkey, CAST(p_size + 45 AS BIGINT) AS iso, CAST(60 + p_size AS BIGINT) AS text, CAST(CASE WHEN p_size * 60 BETWEEN 1880 AND 2100 THEN p_size * 60 END AS BIGINT) AS year, CAST(coalesce(CASE WHEN p_size * 60 BETWEEN 1880 AND 2100 THEN p_size * 60 END, 1950 + p_size) AS BIGINT) AS expected FROM part""")
def durations(spark, d):
    p = table(spark, d, "part")
    m = F.col("p_size") + 45
    iso = F.concat(F.lit("PT"), F.floor(m / 60).cast("string"), F.lit("H"), (m % 60).cast("string"), F.lit("M"))
    raw = (F.col("p_size") * 60).cast("string")
    work = F.concat(F.lit("x-"), (F.col("p_size") + 1950).cast("string"))
    return p.select("p_partkey", big(parse.iso_minutes(iso)).alias("iso"), big(parse.text_minutes(F.concat(F.lit("1 h "), F.lpad(F.col("p_size").cast("string"), 2, "0")))).alias("text"), big(parse.plausible_year(raw)).alias("year"), big(parse.expected_year(raw, work)).alias("expected"))


@query("p17_p18_names_ratings", """SELECT p_partkey, p_brand || '|' || p_type || '|' || p_name AS names, replace(CAST(CAST(round((p_size % 12) + 0.25, 1) AS DECIMAL(4,1)) AS VARCHAR), '.', ',') AS label FROM part WHERE (p_size % 12) + 0.25 <= 10
UNION ALL SELECT p_partkey, p_brand || '|' || p_type || '|' || p_name, NULL FROM part WHERE (p_size % 12) + 0.25 > 10""")
def names_ratings(spark, d):
    p = table(spark, d, "part")
    names = F.array_join(parse.split_names(F.concat(F.col("p_brand"), F.lit(" / "), F.col("p_type"), F.lit(" et "), F.col("p_name"))), "|")
    value = parse.rating(F.concat((F.col("p_size") % 12).cast("string"), F.lit(",25/10 (3 k)")))
    return p.select("p_partkey", names.alias("names"), parse.rating_label(value).alias("label"))


@query("p20_f07_hosts_and_search_urls", r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host, CAST(len(list_filter(regexp_extract_all(url, 'https?://[^\s"''<>]+'), lambda u: regexp_matches(u, '(?i)([?&](q|query|search)=|/search[/?]|/recherche[/?])'))) AS BIGINT) AS banned FROM pages""")
def hosts(spark, d):
    return table(spark, d, "pages").select("page_id", parse.url_host(F.col("url")).alias("host"), F.size(predicates.banned_urls(F.col("url"))).cast("long").alias("banned"))


@query("p21_external_ids", f"""WITH {LINKS}, e AS (SELECT *, CASE WHEN k = 1 AND f <> 'R' THEN 'imdb' WHEN k = 2 AND f <> 'R' AND whole THEN 'tmdb' WHEN k = 3 AND f <> 'R' AND whole THEN 'senscritique' WHEN k = 5 AND f <> 'N' AND whole THEN 'wikidata' WHEN k = 6 AND f <> 'R' AND whole THEN 'wikipedia' END AS provider FROM l)
SELECT l_orderkey, l_linenumber, provider, CASE provider WHEN 'imdb' THEN 'tt' || cents WHEN 'tmdb' THEN CASE f WHEN 'A' THEN 'movie/' ELSE 'tv/' END || part WHEN 'senscritique' THEN CASE f WHEN 'A' THEN 'film/' ELSE 'serie/' END || cents WHEN 'wikidata' THEN 'Q' || o WHEN 'wikipedia' THEN CASE f WHEN 'A' THEN 'fr' ELSE 'en' END || ':Film_' || part END AS ext_id FROM e""")
def external_ids(spark, d):
    """Links of six sites, of works and of other pages, whole and broken."""
    e = parse.external_id(F.col("url"))
    return line_links(spark, d).select("l_orderkey", "l_linenumber", e["provider"].alias("provider"), e["ext_id"].alias("ext_id"))


@query("p24_p27_titles", """SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE CAST(1950 + p_size AS BIGINT) END AS year, CASE WHEN p_partkey % 6 IN (0, 1, 2) THEN p_brand END AS director, p_name || ' (' || p_brand || ') - x|' || p_brand || '|' || p_name || ' - x|' || p_name || ' (' || p_brand || ')' AS variants FROM part""")
def release_titles(spark, d):
    """Topics by their conventions: the director after the year, with notes and tails, none, or words of the trade in its place."""
    p = table(spark, d, "part")
    year = (F.col("p_size") + 1950).cast("string")
    dotted = F.replace("p_name", F.lit(" "), F.lit("."))
    text = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    raw = F.element_at(F.array(
        text("[TEAM] ", F.col("p_name"), " - ", year, " - ", F.col("p_brand"), " VOSTFR 1080p BluRay x264"), text(" [A] [B]", dotted, " (", year, ") ", F.col("p_brand"), " (VO ou VF + bonus)"), text(F.replace("p_name", F.lit(" "), F.lit("_")), "_-_", year, "_-_", F.col("p_brand"), "_web-dl_fr"),
        text("[TEAM] ", dotted, ".", year, ".1080p.BluRay.x264"), text(F.col("p_name"), " – ", year, " – x"), text(F.col("p_name"), " HDRip ", year),
    ), (F.col("p_partkey") % 6 + 1).cast("int"))
    r = parse.release_title(raw)
    named = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") - x"))
    return p.select("p_partkey", r["title"].alias("title"), big(r["year"]).alias("year"), r["director"].alias("director"), F.array_join(parse.title_variants(named), "|").alias("variants"))


@query("p28_p34_p39_labels", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Streaming' WHEN 'F' THEN 'Blu-ray' ELSE 'TV' END AS provenance, CASE WHEN o_orderpriority LIKE '1%' THEN 'documentaire' WHEN o_orderpriority LIKE '2%' THEN 'série' ELSE 'film' END AS form, o_orderstatus || ' · ' || o_orderpriority AS meta FROM orders""")
def labels(spark, d):
    o = table(spark, d, "orders")
    ctx = F.when(F.col("o_orderstatus") == "O", "vu en streaming").when(F.col("o_orderstatus") == "F", "Blu-Ray").otherwise("soirée")
    genre = F.when(F.startswith("o_orderpriority", F.lit("1")), "Documentaire").when(F.startswith("o_orderpriority", F.lit("2")), "Série dramatique").otherwise("Drame")
    return o.select("o_orderkey", parse.provenance(ctx).alias("provenance"), parse.work_form(genre).alias("form"), parse.meta_line(F.col("o_orderstatus"), F.lit(None), F.lit(""), F.col("o_orderpriority")).alias("meta"))


@query("p29_p30_record_ids", """SELECT event_id, substr(sha256('[["' || CAST(event_id AS VARCHAR) || '"],["' || event_type || '"]]'), 1, 20) AS record_id, '=' || event_type || '|' || coalesce('=' || CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END, '-') AS version FROM events""")
def record_ids(spark, d):
    return table(spark, d, "events").select("event_id", parse.record_id(F.col("event_id"), F.col("event_type")).alias("record_id"), parse.version_key(F.col("event_type"), F.when(F.col("user_id") % 2 == 0, F.col("user_id"))).alias("version"))


@query("p41_p42_lines", """SELECT c_custkey, c_mktsegment AS channel, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer""")
def lines(spark, d):
    c = table(spark, d, "customer")
    m = parse.meta_fields(F.concat(F.lit("Nom : "), F.col("c_name"), F.lit(" · Pays: "), F.col("c_nationkey").cast("string")))
    return c.select("c_custkey", parse.channel_of_line(F.concat(F.lit("20:50 · "), F.col("c_mktsegment"))).alias("channel"), F.element_at(m, "Nom").alias("name"), F.element_at(m, "Pays").alias("nation"))


# Pages as captures.


@query("s14_cards", r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<article.*?</article>')) AS h FROM pages)
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(h, '(?s)<h[1-4][^>]*>(.*?)</h[1-4]>', 1), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g'))) AS title_md5, CAST(len(regexp_extract_all(h, '<p[ >]')) AS BIGINT) AS paragraphs FROM a""")
def page_cards(spark, d):
    out = captures.cards(table(spark, d, "pages").withColumnRenamed("page_id", "page_key"))
    return out.select(F.col("page_key").alias("page_id"), F.md5("title").alias("title_md5"), big("paragraphs").alias("paragraphs"))


@query("s16_page_facts", r"""WITH p AS (SELECT page_id, 'https://pages.example/' || page_id AS url, html, page_id % 4 AS k FROM pages), f AS (SELECT page_id, k, unnest([
 struct_pack(fact := 'lang', value := nullif(regexp_extract(html, '<html[^>]*\blang="([^"]+)"', 1), '')), struct_pack(fact := 'title', value := nullif(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<title[^>]*>([\s\S]*?)</title>', 1), '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '[\s\x{a0}]+', ' ', 'g')), '')),
 struct_pack(fact := 'canonical', value := url), struct_pack(fact := 'og:image', value := CASE WHEN k > 0 THEN url || '.jpg' END), struct_pack(fact := 'ld:name', value := CASE WHEN k < 3 THEN 'Name ' || page_id END), struct_pack(fact := 'ld:duration', value := CASE WHEN k = 1 THEN 'PT90M' END)]) AS f FROM p)
SELECT page_id, f.fact AS fact, f.value AS value FROM f WHERE f.value IS NOT NULL""")
def page_facts(spark, d):
    """Pages with a canonical URL, an image and a JSON-LD object, list or graph put into their heads; all facts of them."""
    number = F.col("page_id").cast("string")
    url, k = F.concat(F.lit("https://pages.example/"), number), F.col("page_id") % 4
    node = F.concat(F.lit('{"@type":"Movie","name":"Name '), number, F.lit('"'))
    ld = F.when(k == 0, F.concat(node, F.lit("}"))).when(k == 1, F.concat(F.lit("["), node, F.lit(',"duration":"PT90M"}]'))).when(k == 2, F.concat(F.lit('{"@graph":['), node, F.lit("}]}"))).otherwise("{broken")
    head = F.concat(F.lit('<link rel="canonical" href="'), url, F.lit('">'), F.when(k > 0, F.concat(F.lit('<meta property="og:image" content="'), url, F.lit('.jpg">'))).otherwise(""), F.lit('<script type="application/ld+json">'), ld, F.lit("</script></head>"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("page_key"), F.replace("html", F.lit("</head>"), head).alias("html"), url.alias("url"))
    return captures.page_facts(pages).select(F.col("page_key").alias("page_id"), "fact", "value")


# Schedule lake.


@query("w01_longest_gap", f"""WITH {SCHED}, g AS (SELECT channel, date, start_min, start_min - lag(start_min) OVER (PARTITION BY channel, date ORDER BY start_min) AS gap FROM sched)
SELECT channel, date, CAST(max(gap) AS BIGINT) AS longest_gap, CAST(min(CASE WHEN start_min >= 360 THEN start_min END) AS BIGINT) AS first_day_start, CAST(max(CASE WHEN start_min < 360 THEN 1 ELSE 0 END) AS BIGINT) AS has_night FROM g GROUP BY ALL""")
def w01(spark, d):
    return schedule.longest_gaps(programme(spark, d)).select("channel", "date", *[big(c).alias(c) for c in ("longest_gap", "first_day_start", "has_night")])


_FINE = "sched AS (SELECT * REPLACE (channel || CAST(user_id % 20 AS VARCHAR) AS channel) FROM sched0)"


@query("a09_printed_scope", f"""WITH {SCHED.replace("sched AS", "sched0 AS", 1)}, {_FINE}, g AS (SELECT channel, date, start_min, start_min - lag(start_min) OVER (PARTITION BY channel, date ORDER BY start_min) AS gap FROM sched),
m AS (SELECT channel, date, coalesce(max(gap), 0) AS gap, min(CASE WHEN start_min >= 360 THEN start_min END) AS f, max(CASE WHEN start_min < 360 THEN 1 ELSE 0 END) AS n FROM g GROUP BY ALL)
SELECT channel, count(*) AS days, CAST(sum(n) AS BIGINT) AS night_days, CAST(quantile_disc(f, 0.5) AS BIGINT) AS first_start, CAST(quantile_disc(gap, 0.5) AS BIGINT) AS gap FROM m GROUP BY channel""")
def a09(spark, d):
    """A hundred channels, many of which have a single start on a day."""
    s = programme(spark, d).withColumn("channel", F.concat("channel", (F.col("user_id") % 20).cast("string")))
    return schedule.printed_scope(s).select("channel", "days", "night_days", big("first_start").alias("first_start"), big("gap").alias("gap"))


@query("a10_scope_limits", f"""WITH {SCHED}, s AS (SELECT channel || CAST(user_id % 20 AS VARCHAR) AS channel, date, start_min FROM sched), g AS (SELECT *, start_min - lag(start_min) OVER (PARTITION BY channel, date ORDER BY start_min) AS gap FROM s),
m AS (SELECT channel, date, coalesce(max(gap), 0) AS gap, min(CASE WHEN start_min >= 360 THEN start_min END) AS f, max(CASE WHEN start_min < 360 THEN 1 ELSE 0 END) AS n FROM g GROUP BY ALL), p AS (SELECT channel, sum(n) AS n, quantile_disc(f, 0.5) AS f, quantile_disc(gap, 0.5) AS gap FROM m GROUP BY channel)
SELECT channel, 'evening_only' AS "limit" FROM p WHERE f >= 700 UNION ALL SELECT channel, 'long_gap' FROM p WHERE gap > 240 AND f < 700 UNION ALL SELECT channel, 'no_night' FROM p WHERE n = 0""")
def a10(spark, d):
    s = programme(spark, d).withColumn("channel", F.concat("channel", (F.col("user_id") % 20).cast("string")))
    return schedule.scope_limits(schedule.printed_scope(s), evening=700)


@query("w02_rollover", f"""WITH {SCHED}, w AS (SELECT row_id, user_id, k * 14 AS m, lag(k * 14) OVER (PARTITION BY user_id ORDER BY row_id) AS p FROM sched), b AS (SELECT *, CASE WHEN m < p THEN 1 ELSE 0 END AS back FROM w), s AS (SELECT *, sum(back) OVER (PARTITION BY user_id ORDER BY row_id) AS o FROM b)
SELECT row_id, CAST(o AS BIGINT) AS day_offset, CASE WHEN back = 1 AND (p < 1080 OR m >= 360) THEN 'implausible' WHEN back = 1 AND o > 1 THEN 'second_rollover' END AS rollover_error FROM s""")
def w02(spark, d):
    s = programme(spark, d).withColumn("start_min", F.col("k") * 14)
    return schedule.rollover(s, "user_id", "row_id").select("row_id", "day_offset", "rollover_error")


@query("w04_s17_keep_first", f"WITH {SCHED} SELECT row_id, row_number() OVER (PARTITION BY date, channel, title ORDER BY start_min, row_id) > 1 AS is_duplicate FROM sched")
def w04(spark, d):
    return schedule.keep_first(programme(spark, d), ["date", "channel", "title"], ["start_min", "row_id"]).select("row_id", "is_duplicate")


@query("a08_channel_counts", f"WITH {SCHED} SELECT date, channel, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM sched GROUP BY ALL")
def a08(spark, d):
    return schedule.channel_counts(programme(spark, d))


@query("a12_inventory_quality", f"""WITH {SCHED} SELECT strftime(date - CAST((isodow(date) + 1) % 7 AS INTEGER) + 2, '%G-S%V') AS week, date, count(*) AS n_rows, count(DISTINCT source) AS n_sources, count(DISTINCT channel) AS n_channels, CAST(sum(CASE WHEN start_min < 360 THEN 1 ELSE 0 END) AS BIGINT) AS night_rows, CAST(0 AS BIGINT) AS malformed, count(*) >= 300 AND count(DISTINCT channel) >= 5 AS meets FROM sched GROUP BY ALL""")
def a12(spark, d):
    s = programme(spark, d).withColumn("week", calendar.week_of_saturday(calendar.issue_from(F.col("date"))))
    return schedule.inventory_quality(s, 300, 5)


@query("a26_slots", f"WITH {SCHED} SELECT scope, date, start_min // 60 AS start_min, channel, title_key, string_agg(DISTINCT source, ',' ORDER BY source) AS origins, count(*) AS n, count(*) - 1 AS duplicates FROM sched GROUP BY ALL")
def a26(spark, d):
    return schedule.slots(programme(spark, d).withColumn("start_min", F.floor(F.col("start_min") / 60).cast("int")))


@query("a27_event_conflicts", f"""WITH {SCHED}, g AS (SELECT date, start_min // 10 AS start_min, channel, count(DISTINCT title_key) AS titles, count(DISTINCT work_id) AS works, max(CASE WHEN work_id IS NULL THEN 1 ELSE 0 END) AS o FROM sched GROUP BY ALL)
SELECT date, start_min, channel, titles, works, titles > 1 AND NOT (works = 1 AND o = 0) AS conflict FROM g""")
def a27(spark, d):
    return schedule.event_conflicts(programme(spark, d).withColumn("start_min", F.floor(F.col("start_min") / 10).cast("int")))


@query("j12_near_time", f"WITH {SCHED}, o AS (SELECT DISTINCT date, channel, title_key, start_min FROM sched), n AS (SELECT *, lead(start_min) OVER (PARTITION BY date, channel, title_key ORDER BY start_min) AS next_start FROM o) SELECT * FROM n WHERE next_start IS NOT NULL")
def j12(spark, d):
    return schedule.near_time(programme(spark, d))


@query("s22_append_new", f"WITH {SCHED} SELECT DISTINCT date, channel, title_key FROM sched WHERE row_id % 2 = 1 EXCEPT SELECT date, channel, title_key FROM sched WHERE row_id % 2 = 0")
def s22(spark, d):
    s = programme(spark, d).select("row_id", "date", "channel", "title_key")
    key = ["date", "channel", "title_key"]
    return schedule.append_new(s.where("row_id % 2 = 0"), s.where("row_id % 2 = 1"), key).select(*key)


@query("j27_slot_conflicts", f"WITH {SCHED}, s AS (SELECT row_id, date, start_min // 30 AS start_min, channel, title_key FROM sched) SELECT a.row_id, a.title_key, b.saved_title FROM s a JOIN (SELECT DISTINCT date, start_min, channel, title_key AS saved_title FROM s WHERE row_id % 2 = 0) b USING (date, start_min, channel) WHERE a.row_id % 2 = 1 AND a.title_key <> b.saved_title")
def j27(spark, d):
    s = programme(spark, d).withColumn("start_min", F.floor(F.col("start_min") / 30).cast("int"))
    return schedule.slot_conflicts(s.where("row_id % 2 = 1"), s.where("row_id % 2 = 0")).select("row_id", "title_key", "saved_title")


@query("j24_not_only_stale", f"WITH {SCHED}, c AS (SELECT user_id, bool_and(k % 10 < 8) AS stale FROM sched WHERE k < 60 GROUP BY user_id) SELECT row_id FROM sched WHERE user_id NOT IN (SELECT user_id FROM c WHERE stale)")
def j24(spark, d):
    s = programme(spark, d).withColumn("source_key", F.col("user_id"))
    cap = s.where("k < 60").select("source_key", F.when(F.col("k") % 10 < 8, "stale").otherwise("parsed").alias("status"))
    return schedule.not_only_stale(s, cap).select("row_id")


@query("s13_newest_capture", f"""WITH {SCHED} SELECT user_id, channel, row_id, CASE WHEN k % 4 = 0 THEN 'failed' WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts)) <= 72 * 3600 THEN 'fresh' ELSE 'stale' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, channel ORDER BY (k % 4 <> 0) DESC, ts DESC, row_id) AS r FROM sched) WHERE r = 1""")
def s13(spark, d):
    s = programme(spark, d).select(F.lit("a").alias("adapter"), F.col("user_id").cast("string").alias("url"), "channel", F.lit("2024-01-01").alias("date"), (F.col("k") % 4 != 0).alias("ok"), F.col("ts").alias("fetched_at"), "row_id", "user_id")
    return schedule.newest_capture(s, F.lit("2024-01-31").cast("timestamp"), ttl_hours=72).select("user_id", "channel", "row_id", "state")


@query("j19_required_matrix", f"""WITH c AS (SELECT n_nationkey AS channel FROM nation), days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), a AS (SELECT DISTINCT c_nationkey AS channel, CAST(o_orderdate AS DATE) AS date FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT channel, date FROM c, days EXCEPT SELECT channel, date FROM a""")
def j19(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_custkey").alias("c_custkey"))
    actual = o.join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("channel")), "c_custkey")
    return schedule.required_matrix(table(spark, d, "nation").select(F.col("n_nationkey").alias("channel")), o, actual)


@query("j20_declared_vs_actual", f"""WITH {SCHED}, dec AS (SELECT date, channel, count(*) + max(CASE WHEN channel = 'view' THEN 1 ELSE 0 END) AS declared FROM sched WHERE channel <> 'click' GROUP BY ALL), act AS (SELECT date, channel, count(*) AS actual FROM sched GROUP BY ALL)
SELECT date, channel, declared, actual FROM dec FULL JOIN act USING (date, channel) WHERE declared IS DISTINCT FROM actual""")
def j20(spark, d):
    s = programme(spark, d)
    dec = s.where("channel <> 'click'").groupBy("date", "channel").agg((F.count("*") + F.when(F.first("channel") == "view", 1).otherwise(0)).alias("declared"))
    return schedule.declared_vs_actual(dec, s)


@query("w13_review_sample", f"""WITH {SCHED}, p AS (SELECT row_id, start_min, CAST(date AS VARCHAR) || channel AS page_key FROM sched), r AS (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY start_min, row_id) AS f,
 row_number() OVER (PARTITION BY page_key ORDER BY CASE WHEN start_min BETWEEN 1230 AND 1350 THEN 0 ELSE 1 END, start_min, row_id) AS q, row_number() OVER (PARTITION BY page_key ORDER BY CASE WHEN start_min < 360 THEN 0 ELSE 1 END, start_min, row_id) AS n FROM p),
o AS (SELECT *, CASE WHEN f = 1 THEN 0 WHEN q = 1 AND start_min BETWEEN 1230 AND 1350 THEN 1 WHEN n = 1 AND start_min < 360 THEN 2 ELSE 3 END AS o FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY o, start_min, row_id) AS pick FROM o)
SELECT page_key, row_id, pick FROM k WHERE pick <= 3""")
def w13(spark, d):
    s = programme(spark, d).withColumn("page_key", F.concat(F.col("date").cast("string"), F.col("channel")))
    return schedule.review_sample(s).select("page_key", "row_id", big("pick").alias("pick"))


@query("w12_stratified_review", f"""WITH RECURSIVE {SCHED}, s AS (SELECT row_id, date, start_min, channel, 'p' || user_id % 5 AS page_key, strftime(date - CAST((isodow(date) + 1) % 7 AS INTEGER) + 2, '%G-S%V') AS week FROM sched),
n AS (SELECT week, date, page_key, count(*) AS c, dense_rank() OVER (PARTITION BY week ORDER BY date) AS dn FROM s GROUP BY week, date, page_key), y AS (SELECT DISTINCT week, date, dn FROM n),
r AS (SELECT DISTINCT week, CAST(0 AS BIGINT) AS dn, CAST(NULL AS DATE) AS date, CAST(NULL AS VARCHAR) AS page_key, CAST([] AS VARCHAR[]) AS used FROM n
 UNION ALL SELECT week, dn, date, page_key, CASE WHEN page_key IS NULL THEN used ELSE list_append(used, page_key) END FROM (SELECT y.week, y.dn, y.date, n.page_key, used, row_number() OVER (PARTITION BY y.week ORDER BY c DESC NULLS LAST, n.page_key) AS x
   FROM r JOIN y ON y.week = r.week AND y.dn = r.dn + 1 LEFT JOIN n ON n.week = y.week AND n.dn = y.dn AND NOT list_contains(used, n.page_key)) WHERE x = 1),
h AS (SELECT s.*, row_number() OVER (PARTITION BY week, date ORDER BY start_min, row_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY week, date) // 5) AS step FROM s JOIN r USING (week, date, page_key)),
t AS (SELECT *, row_number() OVER (PARTITION BY week, date, channel ORDER BY i) > 1 AS again FROM h WHERE i % step = 0)
SELECT week, date, page_key, channel, CAST(start_min AS BIGINT) AS start_min, row_id FROM (SELECT *, row_number() OVER (PARTITION BY week, date ORDER BY again, i) AS place FROM t) WHERE place <= 5""")
def w12(spark, d):
    """Five pages, so that the days of a week run out of new ones."""
    s = programme(spark, d).withColumn("page_key", F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string"))).withColumn("week", calendar.week_of_saturday(calendar.issue_from(F.col("date"))))
    return schedule.stratified_review(s).withColumn("start_min", big("start_min"))


# Identity.


@query("j01_last_title_wins", f"WITH {WORKS}, t AS (SELECT {KEY.format('title')} AS k, arg_max(id, pos) AS work_id FROM works GROUP BY 1) SELECT row_id, work_id FROM (SELECT p_partkey AS row_id, {KEY.format('p_name')} AS k FROM part) LEFT JOIN t USING (k)")
def j01(spark, d):
    w = works(spark, d)
    return identity.by_title(w.select(F.col("id").alias("row_id"), "title"), w).select("row_id", "work_id")


@query("j02_alias_index", f"WITH {WORKS}, n AS (SELECT id, {KEY.format('title')} AS k FROM works UNION SELECT id, {KEY.format('director')} FROM works) SELECT k AS title_key, count(*) AS n_matches, min(id) AS first_id, max(id) AS last_id FROM n GROUP BY k")
def j02(spark, d):
    w = works(spark, d).withColumn("aliases", F.array("director"))
    return identity.alias_index(w).select("title_key", "n_matches", F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


@query("j03_resolve", f"""WITH {WORKS}, r AS (SELECT event_id AS row_id, CASE WHEN event_id % 5 = 0 THEN user_id WHEN event_id % 5 = 1 THEN 999999999 END AS work_ref, w.title, w.director, w.year FROM events JOIN works w ON w.id = event_id % (SELECT count(*) FROM part)),
t AS (SELECT title, count(*) AS n, min(id) AS id FROM works GROUP BY ALL), y AS (SELECT title, year, count(*) AS n, min(id) AS id FROM works GROUP BY ALL), x AS (SELECT title, director, count(*) AS n, min(id) AS id FROM works GROUP BY ALL)
SELECT row_id, CASE WHEN work_ref IS NOT NULL AND u.id IS NULL THEN 'id_unknown' WHEN work_ref IS NOT NULL AND u.title = r.title THEN 'id' WHEN work_ref IS NOT NULL THEN 'id_title_conflict' WHEN t.n = 1 THEN 'title' WHEN y.n = 1 THEN 'title_year' WHEN x.n = 1 THEN 'title_director' ELSE 'ambiguous' END AS reason,
CASE WHEN work_ref IS NOT NULL THEN CASE WHEN u.title = r.title THEN work_ref END WHEN t.n = 1 THEN t.id WHEN y.n = 1 THEN y.id WHEN x.n = 1 THEN x.id END AS work_id
FROM r LEFT JOIN works u ON u.id = work_ref JOIN t ON t.title = r.title JOIN y ON y.title = r.title AND y.year = r.year JOIN x ON x.title = r.title AND x.director = r.director""")
def j03(spark, d):
    w = works(spark, d).withColumn("aliases", F.array().cast("array<string>"))
    n = w.count()
    e = table(spark, d, "events")
    ref = F.when(F.col("event_id") % 5 == 0, F.col("user_id")).when(F.col("event_id") % 5 == 1, F.lit(999999999))
    rows = e.select(F.col("event_id").alias("row_id"), ref.alias("work_ref"), (F.col("event_id") % n).alias("wid")).join(w.select(F.col("id").alias("wid"), "title", "director", "year"), "wid")
    # titles recur many times: the rows are resolved once per distinct title, director, year and id
    kinds = rows.select("title", "director", "year", "work_ref").distinct().withColumn("row_id", F.monotonically_increasing_id())
    got = identity.resolve(kinds, w).select(F.col("title").alias("t"), F.col("director").alias("dr"), F.col("year").alias("y"), F.col("work_ref").alias("r"), "reason", "work_id")
    return rows.join(got, (F.col("title") == F.col("t")) & (F.col("director") == F.col("dr")) & (F.col("year") == F.col("y")) & F.col("work_ref").eqNullSafe(F.col("r"))).select("row_id", "reason", "work_id")


@query("j04_id_then_title", f"WITH {WORKS}, t AS (SELECT {KEY.format('title')} AS k, arg_max(id, pos) AS tid FROM works GROUP BY 1) SELECT p_partkey AS row_id, coalesce(w.id, tid) AS work_id FROM part LEFT JOIN works w ON w.id = p_partkey * 3 LEFT JOIN t ON t.k = {KEY.format('p_name')}")
def j04(spark, d):
    w = works(spark, d)
    return identity.id_then_title(w.select(F.col("id").alias("row_id"), (F.col("id") * 3).alias("work_ref"), "title"), w).select("row_id", "work_id")


@query("j05_named_lookup", f"""WITH {SCHED}, e AS (SELECT row_id AS e_id, CASE WHEN row_id % 2 = 0 THEN work_id END AS e_work_id, title_key AS e_title_key FROM sched), r AS (SELECT DISTINCT date, work_id, title_key FROM sched)
SELECT date, work_id, title_key, e_id FROM r JOIN e ON work_id = e_work_id UNION SELECT date, work_id, title_key, e_id FROM r JOIN e ON e_work_id IS NULL AND title_key = e_title_key""")
def j05(spark, d):
    s = programme(spark, d)
    e = s.select(F.col("row_id").alias("e_id"), F.when(F.col("row_id") % 2 == 0, F.col("work_id")).alias("e_work_id"), F.col("title_key").alias("e_title_key"))
    return identity.named_lookup(s.select("date", "work_id", "title_key").distinct(), e).select("date", "work_id", "title_key", "e_id")


@query("j06_legacy_ids", """WITH w AS (SELECT p_partkey AS id, [p_partkey + 1, p_partkey + 1000000] AS l FROM part WHERE p_partkey % 3 = 0), i AS (SELECT id AS a, id, 0 AS o FROM w UNION ALL SELECT unnest(l), id, 1 FROM w), b AS (SELECT a, arg_min(id, o * 100000000 + id) AS id FROM i GROUP BY a)
SELECT l_partkey AS ref, id, count(*) AS n FROM lineitem LEFT JOIN b ON a = l_partkey GROUP BY ALL""")
def j06(spark, d):
    w = works(spark, d).where("id % 3 = 0").select("id", F.array(F.col("id") + 1, F.col("id") + 1_000_000).alias("legacy_ids"))
    refs = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("ref")).agg(F.count("*").alias("n"))
    return identity.legacy_lookup(refs, w).select("ref", "id", "n")


@query("j28_orphan_ids", """WITH w AS (SELECT p_partkey AS id, unnest([p_partkey + 1, p_partkey + 1000000]) AS l FROM part WHERE p_partkey % 3 = 0)
SELECT DISTINCT l AS id, 'legacy_used' AS problem FROM w WHERE l IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT DISTINCT l, 'legacy_shadows' FROM w WHERE l IN (SELECT p_partkey FROM part)""")
def j28(spark, d):
    w = works(spark, d).select("id", F.when(F.col("id") % 3 == 0, F.array(F.col("id") + 1, F.col("id") + 1_000_000)).otherwise(F.array().cast("array<bigint>")).alias("legacy_ids"))
    return identity.orphan_ids(table(spark, d, "lineitem").select(F.col("l_partkey").alias("ref")), w).select(big("id").alias("id"), "problem")


@query("a19_id_owners", """WITH l AS (SELECT DISTINCT l_partkey AS work_id, 'tt' || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') AS ext_id FROM lineitem WHERE l_linenumber = 1) SELECT 'imdb' AS provider, ext_id, count(*) AS claims, CASE WHEN count(*) = 1 THEN min(work_id) END AS owner FROM l GROUP BY ext_id""")
def a19(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber = 1")
    return identity.id_owners(li.select(F.col("l_partkey").alias("work_id"), F.concat(F.lit("https://www.imdb.com/title/tt"), F.lpad(F.col("l_suppkey").cast("string"), 7, "0"), F.lit("/")).alias("url")))


@query("j13_scoped_records", f"""WITH {SCHED}, r AS (SELECT row_id AS r_id, title_key AS t, CASE WHEN row_id % 2 = 0 THEN date END AS d, CASE WHEN row_id % 3 = 0 THEN channel END AS c, CASE WHEN row_id % 11 = 0 THEN 'stable' ELSE 'dynamic' END AS s FROM (SELECT min(row_id) AS row_id, title_key, channel, arg_min(date, row_id) AS date FROM sched GROUP BY title_key, channel))
SELECT row_id, r_id FROM sched JOIN r ON title_key = t WHERE s = 'stable' OR ((d IS NULL OR d = date) AND (c IS NULL OR c = channel))""")
def j13(spark, d):
    s = programme(spark, d)
    pick = lambda n, c: F.when(F.col("row_id") % n == 0, F.col(c))
    r = s.groupBy("title_key", "channel").agg(F.min("row_id").alias("row_id"), F.min_by("date", "row_id").alias("date")).select(F.col("row_id").alias("r_id"), F.col("title_key").alias("r_title_key"), pick(2, "date").alias("r_date"), pick(3, "channel").alias("r_channel"), F.when(F.col("row_id") % 11 == 0, "stable").otherwise("dynamic").alias("stability"))
    return identity.scoped_records(r, s).select("row_id", "r_id")


@query("j14_phrase_containment", rf"""WITH n AS (SELECT item_id AS name_id, trim(regexp_replace(replace(replace(lower(strip_accents(text)), 'œ', 'oe'), 'æ', 'ae'), '[^a-z0-9]+', ' ', 'g')) AS nk FROM benchmark UNION ALL SELECT DISTINCT -1 - l_suppkey % 7, 'src' || l_suppkey % 7 FROM lineitem),
t AS (SELECT doc_id AS text_id, ' ' || trim(regexp_replace(replace(replace(lower(strip_accents(text)), 'œ', 'oe'), 'æ', 'ae'), '[^a-z0-9]+', ' ', 'g')) || ' ' || source || ' ' AS x FROM documents)
SELECT DISTINCT text_id, name_id FROM t JOIN n ON contains(x, ' ' || nk || ' ') WHERE nk <> ''""")
def j14(spark, d):
    """Whole items of the benchmark as names, and names of one word, in whole documents that end in their source."""
    one = (F.col("l_suppkey") % 7).alias("k")
    single = table(spark, d, "lineitem").select(one).distinct().select((-1 - F.col("k")).alias("name_id"), F.concat(F.lit("Src"), F.col("k").cast("string")).alias("name"))
    names = table(spark, d, "benchmark").select(F.col("item_id").alias("name_id"), F.col("text").alias("name")).unionByName(single)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), F.concat_ws(" ", "text", "source").alias("text"))
    return identity.phrase_containment(texts, names)


@query("j17_unseen", f"""WITH c AS (SELECT DISTINCT e.user_id, p_partkey AS work_id, p_name AS title FROM events e JOIN part ON p_partkey = event_id % 200), s AS (SELECT DISTINCT user_id, p_partkey AS work_id, CASE WHEN event_id % 2 = 0 THEN p_name ELSE 'none' END AS title FROM events JOIN part ON p_partkey = event_id % 150 WHERE event_type = 'purchase')
SELECT user_id, work_id FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = c.user_id AND (s.work_id = c.work_id OR s.title = c.title))""")
def j17(spark, d):
    e, w = table(spark, d, "events"), works(spark, d).select(F.col("id").alias("work_id"), "title")
    cards = e.select("user_id", (F.col("event_id") % 200).alias("work_id")).distinct().join(w, "work_id")
    seen = e.where("event_type = 'purchase'").select("user_id", "event_id", (F.col("event_id") % 150).alias("work_id")).join(w, "work_id").withColumn("title", F.when(F.col("event_id") % 2 == 0, F.col("title")).otherwise("none"))
    return identity.without_seen(cards, seen).select("user_id", "work_id")


@query("j08_review_ladder", f"""WITH {SCHED}, s AS (SELECT row_id, date, start_min // 120 AS start_min, channel, title_key FROM sched), r AS (SELECT row_id AS c, date, start_min, channel, title_key FROM s),
e AS (SELECT s.row_id, 1 AS basis, c FROM s JOIN r USING (date, start_min, channel, title_key) UNION ALL SELECT s.row_id, 2, c FROM s JOIN r USING (date, start_min, channel) UNION ALL SELECT s.row_id, 3, c FROM s JOIN r USING (date, channel, title_key)),
g AS (SELECT row_id, basis, min(c) AS c, count(DISTINCT c) AS n FROM e GROUP BY ALL), b AS (SELECT row_id, min(basis) AS basis FROM g GROUP BY ALL)
SELECT s.row_id, CAST(b.basis AS BIGINT) AS basis, CASE WHEN n = 1 THEN c END AS candidate, n FROM s LEFT JOIN b USING (row_id) LEFT JOIN g ON g.row_id = b.row_id AND g.basis = b.basis""")
def j08(spark, d):
    s = programme(spark, d).withColumn("start_min", F.floor(F.col("start_min") / 120).cast("int")).select("row_id", "date", "start_min", "channel", "title_key")
    r = s.select("date", "start_min", "channel", "title_key", F.lit(None).cast("string").alias("reviewed_key"), F.col("row_id").alias("review_id"))
    return identity.review_ladder(s, r).select("row_id", big("basis").alias("basis"), "candidate", "n")


@query("j26_best_of", f"WITH {WORKS}, t AS (SELECT {KEY.format('title')} AS k, arg_min(id, pos) AS work_id FROM works GROUP BY 1) SELECT p_partkey AS list_pos, work_id FROM part LEFT JOIN t ON k = {KEY.format('p_name')}")
def j26(spark, d):
    w = works(spark, d)
    return identity.best_of(w.select(F.col("id").alias("list_pos"), "title"), w).select("list_pos", "work_id")


@query("j29_schedule_evidence", f"""WITH {SCHED}, c AS (SELECT row_id AS cand_id, title_key, channel, start_min, CAST(row_id % 9 AS INTEGER) AS rank FROM sched)
SELECT cand_id, count(DISTINCT s.date) AS n_days, CASE WHEN count(DISTINCT s.date) = 1 THEN min(s.date) END AS date, CASE WHEN c.rank <= 5 THEN 'selected' ELSE 'reserve' END AS role FROM c LEFT JOIN sched s USING (title_key, channel, start_min) GROUP BY cand_id, c.rank""")
def j29(spark, d):
    s = programme(spark, d)
    c = s.select(F.col("row_id").alias("cand_id"), "title_key", "channel", "start_min", (F.col("row_id") % 9).cast("int").alias("rank"), F.lit(5).alias("target"))
    return identity.schedule_evidence(c, s).select("cand_id", "n_days", "date", "role")


# Consensus.


_OFFERS = """o AS (SELECT l_partkey AS work_id, field, CAST(l_linenumber AS VARCHAR) AS source, l_linenumber AS ladder, CASE field WHEN 'country' THEN ['A', 'A', 'A', 'B'][CAST(l_suppkey % 4 + 1 AS INTEGER)] WHEN 'genre' THEN ['A / B', 'C & a', 'b, D', 'D'][CAST(l_suppkey % 4 + 1 AS INTEGER)] ELSE ['X et Y', 'Y / X', 'x; y', 'X'][CAST(l_suppkey % 4 + 1 AS INTEGER)] END AS value FROM lineitem, (SELECT unnest(['country', 'genre', 'director']) AS field))"""


@query("a21_merge_facts", f"""WITH {_OFFERS}, c AS (SELECT p_partkey AS work_id, 'genre' AS field, CASE p_size % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'a / Z' ELSE 'E' END AS current FROM part),
k AS (SELECT *, CASE field WHEN 'country' THEN [lower(value)] ELSE list_sort(list_distinct(list_transform(regexp_split_to_array(lower(value), '\\s*[/,;&]\\s*|\\s+et\\s+'), lambda x: trim(x)))) END AS names FROM o),
f AS (SELECT work_id, field, arg_min(value, (ladder, value)) AS value, arg_min(names, (ladder, value)) AS first FROM k GROUP BY ALL),
g AS (SELECT k.work_id, k.field, f.value, any_value(first) AS first, count(DISTINCT source) AS n_sources, bool_and(CASE WHEN k.field = 'genre' THEN list_has_any(names, first) ELSE names = first END) AS agree FROM k JOIN f USING (work_id, field) GROUP BY k.work_id, k.field, f.value)
SELECT work_id, field, CASE WHEN agree THEN value END AS value, n_sources,
 CASE WHEN NOT agree THEN 'conflict' WHEN coalesce(trim(current), '') = '' THEN 'proposed' WHEN list_has_any(list_transform(string_split(lower(current), '/'), lambda x: trim(x)), first) THEN 'agrees' ELSE 'differs' END AS status FROM g LEFT JOIN c USING (work_id, field)""")
def a21(spark, d):
    """Lines as sources of a part's country, genre and director; some genres have names in common with the first source's only."""
    li, n = table(spark, d, "lineitem"), F.col("l_suppkey") % 4
    offer = lambda field, *values: F.struct(F.lit(field).alias("field"), F.element_at(F.array(*map(F.lit, values)), n.cast("int") + 1).alias("value"))
    each = F.explode(F.array(offer("country", "A", "A", "A", "B"), offer("genre", "A / B", "C & a", "b, D", "D"), offer("director", "X et Y", "Y / X", "x; y", "X")))
    f = li.select(F.col("l_partkey").alias("work_id"), F.col("l_linenumber").cast("string").alias("source"), F.col("l_linenumber").alias("ladder"), each.alias("o")).select("work_id", "source", "ladder", "o.*")
    size = F.col("p_size") % 3
    cat = table(spark, d, "part").select(F.col("p_partkey").alias("work_id"), F.lit("genre").alias("field"), F.when(size == 0, " ").when(size == 1, "a / Z").otherwise("E").alias("current"))
    return consensus.merge_facts(f, {"director": "set", "genre": "share"}, cat)


@query("a25_summary", "SELECT o_orderstatus AS status, o_orderpriority AS field, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def a25(spark, d):
    return consensus.summarise(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("field"))).drop("level")


@query("a23_year_spread", """WITH y AS (SELECT l_partkey AS work_id, CAST(l_linenumber AS VARCHAR) AS source, year(l_shipdate) AS y, CASE WHEN l_partkey % 2 = 0 THEN 1998 END AS cy FROM lineitem)
SELECT work_id, NULL AS source, 'identity_conflict' AS problem FROM y GROUP BY work_id HAVING max(cy) IS NULL AND max(y) - min(y) > 2 UNION ALL SELECT work_id, source, 'year_mismatch' FROM y WHERE cy IS NOT NULL AND abs(y - cy) > 2""")
def a23(spark, d):
    li = table(spark, d, "lineitem")
    return consensus.year_spread(li.select(F.col("l_partkey").alias("work_id"), F.col("l_linenumber").cast("string").alias("source"), F.year("l_shipdate").alias("year"), F.when(F.col("l_partkey") % 2 == 0, 1998).alias("catalogue_year")))


@query("s23_fill_empty", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_brand END AS director, CASE WHEN p_partkey % 3 = 0 THEN 'src' END AS director_source, CASE WHEN p_partkey % 3 = 0 THEN 'director' ELSE '' END AS filled FROM part""")
def s23(spark, d):
    w = works(spark, d).select("id", F.when(F.col("id") % 3 == 0, " ").otherwise(F.col("director")).alias("director"), F.lit(None).cast("string").alias("director_source"))
    return consensus.fill_empty(w, w.select("id", F.lit("new").alias("director"), F.lit("src").alias("director_source")), {"director": ["director_source"]})


@query("s24_upsert_conflicts", "SELECT p_partkey AS id, 'imdb' AS key, p_brand AS current, p_type AS proposed FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0")
def s24(spark, d):
    """All parts as a catalogue, and as a plan that links them anew; each has its links under one of two keys."""
    p = table(spark, d, "part")
    mk = lambda n, v: p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.create_map(F.when(F.col("p_partkey") % n == 0, "imdb").otherwise(f"other {v}"), F.col(v)).alias("links"))
    return consensus.upsert_works(mk(2, "p_brand"), mk(3, "p_type"))[1]


@query("p37_j30_hydrate", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE p_brand END AS director FROM events LEFT JOIN part ON p_partkey = event_id % 100")
def p37(spark, d):
    items = table(spark, d, "events").select("event_id", (F.col("event_id") % 100).alias("work_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("director"))
    return identity.hydrate(items, works(spark, d), ["director"], []).select("event_id", "director")


# Readers.


@query("a01_totals", """WITH w AS (SELECT p_partkey, p_brand, p_size FROM part) SELECT count(*) AS works, count(*) FILTER (p_size % 2 = 0) AS enriched, count(DISTINCT p_brand) AS directors, (SELECT count(DISTINCT CAST(l_shipdate AS DATE) - CAST((isodow(l_shipdate) + 1) % 7 AS INTEGER)) FROM lineitem) AS weeks FROM w""")
def a01(spark, d):
    occ = occurrences(spark, d).select("id", "week").distinct().groupBy("id").agg(F.collect_list(F.struct("week")).alias("occurrences"))
    w = works(spark, d).join(occ, "id", "left").withColumn("ratings", F.when(F.col("year") % 2 == 0, F.create_map(F.lit("IMDb"), F.lit("7,0"))))
    return readers.totals(w)


@query("a02_top_directors", "SELECT p_brand AS director, count(*) AS n, CAST(floor(100.0 * count(*) / max(count(*)) OVER () + 0.5) AS BIGINT) AS pct FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 12")
def a02(spark, d):
    return readers.top_share(works(spark, d), "director")


@query("a03_by_director", "SELECT p_brand AS person, count(*) AS n, string_agg(lpad(CAST(p_partkey AS VARCHAR), 10, '0'), ',' ORDER BY p_partkey) AS ids FROM part GROUP BY p_brand")
def a03(spark, d):
    return readers.by_director(works(spark, d))


@query("a04_facets", "SELECT 'genre' AS facet, p_type AS value, count(*) AS n FROM part GROUP BY p_type UNION ALL SELECT 'director', p_brand, count(*) FROM part GROUP BY p_brand UNION ALL SELECT 'year', CAST(p_size + 1950 AS VARCHAR), count(*) FROM part GROUP BY p_size")
def a04(spark, d):
    return readers.facets(works(spark, d), ["genre", "director", "year"])


@query("a05_editions", "SELECT l_partkey AS work, count(*) AS n, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS editions FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def a05(spark, d):
    return readers.editions(table(spark, d, "lineitem").select(F.col("l_partkey").alias("work"), F.col("l_linenumber").cast("string").alias("edition")))


@query("a06_u01_s07_calendar", """WITH e AS (SELECT CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'O' THEN 'physical' WHEN 'F' THEN 'streaming' ELSE 'expiration' END AS kind FROM orders) SELECT date, count(*) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM e GROUP BY date""")
def a06(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"), "o_orderstatus", F.col("o_orderkey").alias("work"))
    part = lambda c: o.where(c).drop("o_orderstatus")
    return readers.per_date(readers.release_events(part("o_orderstatus = 'O'").withColumn("label", F.lit("x")), part("o_orderstatus = 'F'"), part("o_orderstatus NOT IN ('O','F')")))


@query("a07_a31_status_counts", "SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'absent') AS absent FROM events GROUP BY user_id")
def a07(spark, d):
    return planning.status_matrix(table(spark, d, "events"), "user_id", "event_type", ["view", "purchase", "absent"])


@query("f01_catalogue_search", f"WITH {WORKS} SELECT id FROM works WHERE contains(strip_accents(lower(concat_ws(' ', title, director))), 'red') AND genre = 'ECONOMY' AND contains(director, '#1')")
def f01(spark, d):
    w = works(spark, d)
    return w.where(predicates.catalogue_search([F.col("title"), F.col("director")], q="Réd", kind=(F.col("genre"), "ECONOMY"), country=(F.col("director"), "#1"))).select("id")


@query("l01_l03_search_page", f"WITH {WORKS} SELECT id, title FROM works WHERE contains(lower(title), 'e') ORDER BY title, id LIMIT 120")
def l01(spark, d):
    return works(spark, d).where(predicates.catalogue_search([F.col("title")], q="e")).orderBy(*readers.catalogue_order("title")).limit(120).select("id", "title")


@query("l06_top_per_group", f"WITH {POOL} SELECT pool_id, work_id, qty FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY qty DESC, work_id) AS r FROM pool) WHERE r <= 8")
def l06(spark, d):
    return readers.top_k(pool(spark, d), ["pool_id"], [F.desc("qty"), F.col("work_id")], 8).select("pool_id", "work_id", "qty")


@query("w15_l04_queue_page", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place > 100 AND place <= 200")
def w15(spark, d):
    q = planning.priority_queue(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), [F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")])
    return planning.page_of(q, 100, 100).select("o_orderkey", "place")


@query("l05_latest_issue", f"""WITH {OCC} SELECT max(week) AS week FROM occ""")
def l05(spark, d):
    occ = occurrences(spark, d)
    seq = freshness.issue_sequence(occ).withColumn("status", F.lit("published")).withColumn("is_latest", F.lit(False))
    return readers.latest_issue(seq)


@query("j21_watch_alerts", f"WITH w AS (SELECT DISTINCT user_id, p_name AS title FROM events JOIN part ON p_partkey = event_id % 64 WHERE event_type = 'view') SELECT w.user_id, p_partkey AS release_id FROM w JOIN part ON {KEY.format('p_name')} = {KEY.format('w.title')} WHERE p_size = 7")
def j21(spark, d):
    e = table(spark, d, "events").where("event_type = 'view'").select("user_id", (F.col("event_id") % 64).alias("id"))
    w = works(spark, d)
    watch = e.join(w.select("id", "title"), "id").select("user_id", "title").distinct()
    return readers.watch_alerts(watch, w.where("year = 1957").select(F.col("id").alias("release_id"), F.col("title").alias("work"))).select("user_id", "release_id")


@query("u05_multiset_difference", "SELECT 'lost' AS side, o_orderstatus AS v, count(*) FILTER (o_orderkey % 2 = 0) - count(*) FILTER (o_orderkey % 2 = 1) AS n FROM orders GROUP BY 2 HAVING count(*) FILTER (o_orderkey % 2 = 0) > count(*) FILTER (o_orderkey % 2 = 1) UNION ALL SELECT 'added', o_orderstatus, count(*) FILTER (o_orderkey % 2 = 1) - count(*) FILTER (o_orderkey % 2 = 0) FROM orders GROUP BY 2 HAVING count(*) FILTER (o_orderkey % 2 = 1) > count(*) FILTER (o_orderkey % 2 = 0)")
def u05(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    return readers.same_multiset(o.where("o_orderkey % 2 = 0").select("v"), o.where("o_orderkey % 2 = 1").select("v")).groupBy("side", "v").agg(F.count("*").alias("n"))


# Personalisation and planning.


@query("w07_visible_cards", f"""WITH {POOL}, u AS (SELECT DISTINCT user_id, event_id % 100 + 1 AS pool_id FROM events), s AS (SELECT DISTINCT user_id, event_id % 50 AS work_id FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, pool_id, work_id, rank, target FROM u JOIN pool USING (pool_id)),
l AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = c.user_id AND s.work_id = c.work_id) AND (rank <= target OR work_id % 2 = 0)), o AS (SELECT *, row_number() OVER (PARTITION BY user_id, pool_id ORDER BY rank > target, rank, work_id) AS slot FROM l)
SELECT user_id, pool_id, work_id, slot FROM o WHERE slot <= target""")
def w07(spark, d):
    e = table(spark, d, "events")
    p = pool(spark, d).withColumn("eligible", F.col("work_id") % 2 == 0).withColumn("title", F.concat(F.lit("t"), F.col("work_id").cast("string")))
    seen = e.where("event_type = 'purchase'").select("user_id", (F.col("event_id") % 50).alias("work_id"), F.lit(None).cast("string").alias("title"))
    return personal.visible_cards(e.select("user_id", (F.col("event_id") % 100 + 1).alias("pool_id")), p, seen).select("user_id", "pool_id", "work_id", big("slot").alias("slot"))


@query("w08_family_claims", f"""WITH RECURSIVE {POOL}, e AS (SELECT user_id, CAST(props->>'$.k' AS INTEGER) AS k, event_type, event_id FROM events), u AS (SELECT DISTINCT user_id, (k + 1) // 4 AS family FROM e),
s AS (SELECT DISTINCT user_id, work_id FROM e JOIN pool ON pool_id = k + 1 AND rank = 1 + event_id % 7 WHERE event_type IN ('purchase', 'view')),
c AS (SELECT pool_id // 4 AS family, pool_id % 4 AS page_pos, work_id, rank, target FROM pool),
m AS (SELECT u.user_id, u.family, page_pos, c.work_id, rank, target, s.work_id IS NOT NULL AS seen FROM u JOIN c USING (family) LEFT JOIN s ON s.user_id = u.user_id AND s.work_id = c.work_id WHERE rank <= target),
shown AS (SELECT user_id, family, page_pos, work_id, row_number() OVER (PARTITION BY user_id, family, page_pos ORDER BY rank, work_id) AS slot FROM m WHERE NOT seen),
n0 AS (SELECT user_id, family, page_pos, count(*) FILTER (NOT seen) AS visible, max(target) - count(*) FILTER (NOT seen) AS need FROM m GROUP BY user_id, family, page_pos),
need AS (SELECT *, row_number() OVER (PARTITION BY user_id, family ORDER BY page_pos) AS k FROM n0 WHERE need > 0),
offers AS (SELECT n.user_id, n.family, n.page_pos, n.k, any_value(n.need) AS need, any_value(n.visible) AS visible, coalesce(list(c.work_id ORDER BY rank, c.work_id) FILTER (rank > target AND c.work_id % 2 = 0
  AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = n.user_id AND s.work_id = c.work_id) AND NOT EXISTS (SELECT 1 FROM shown h WHERE h.user_id = n.user_id AND h.family = n.family AND h.work_id = c.work_id)), []) AS works
  FROM need n JOIN c USING (family, page_pos) GROUP BY n.user_id, n.family, n.page_pos, n.k),
fold AS (SELECT user_id, family, page_pos, k, visible, list_slice(works, 1, need) AS took, list_slice(works, 1, need) AS claimed FROM offers WHERE k = 1
  UNION ALL SELECT o.user_id, o.family, o.page_pos, o.k, o.visible, list_slice(list_filter(o.works, lambda w: NOT list_contains(f.claimed, w)), 1, o.need), list_concat(f.claimed, list_slice(list_filter(o.works, lambda w: NOT list_contains(f.claimed, w)), 1, o.need))
  FROM fold f JOIN offers o ON o.user_id = f.user_id AND o.family = f.family AND o.k = f.k + 1)
SELECT user_id, family, page_pos, work_id, slot FROM shown UNION ALL SELECT user_id, family, page_pos, took[i], visible + i FROM (SELECT *, unnest(range(1, len(took) + 1)) AS i FROM fold)""")
def w08(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    p = pool(spark, d)
    seen = e.where("event_type IN ('purchase', 'view')").join(p.where("rank <= 7"), (F.col("pool_id") == F.col("k") + 1) & (F.col("rank") == F.col("event_id") % 7 + 1)).select("user_id", "work_id")
    pages = p.select(F.floor(F.col("pool_id") / 4).alias("family"), (F.col("pool_id") % 4).alias("page_pos"), "work_id", "rank", "target", (F.col("work_id") % 2 == 0).alias("eligible"))
    out = personal.family_claims(e.select("user_id", F.floor((F.col("k") + 1) / 4).alias("family")), pages, seen)
    return out.withColumn("slot", big("slot"))


@query("w10_library_row", f"""WITH {POOL}, t AS (SELECT *, CASE WHEN rank <= target AND work_id % 3 <> 0 THEN 0 WHEN rank > target AND work_id % 3 <> 0 AND work_id % 2 = 0 THEN 1 WHEN rank <= target THEN 2 END AS tier FROM pool),
o AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY tier, rank) AS slot FROM t WHERE tier IS NOT NULL) SELECT pool_id, work_id, slot FROM o WHERE slot <= target""")
def w10(spark, d):
    rows = pool(spark, d).select(F.lit(1).alias("user_id"), "pool_id", "work_id", "rank", "target", (F.col("work_id") % 3 == 0).alias("played"), (F.col("work_id") % 2 == 0).alias("resolved"))
    return personal.library_row(rows).select("pool_id", "work_id", big("slot").alias("slot"))


@query("w03_latest_topic", "SELECT user_id AS topic_id, arg_max(event_id, ts) AS row_id FROM events GROUP BY user_id")
def w03(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").alias("topic_id"), F.col("event_id").alias("row_id"), F.col("ts").alias("activity_at"))
    return personal.latest_topic(t).select("topic_id", "row_id")


@query("f05_recent_window", "SELECT event_id FROM events WHERE epoch(ts) >= epoch(TIMESTAMP '2024-01-20 12:00:00') - 168 * 3600 AND epoch(ts) <= epoch(TIMESTAMP '2024-01-20 12:00:00') + 600")
def f05(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.where(predicates.recent(F.col("at"), F.lit("2024-01-20 12:00:00").cast("timestamp"), F.lit(500))).select("event_id")


@query("t04_future_guard", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:10:00'")
def t04(spark, d):
    from gridloom.streaming import jobs

    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("activity_at"))
    return jobs.guarded(e, "2024-01-20 12:00:00", 168).select("event_id")


@query("w05_day_ranks", f"WITH {SCHED} SELECT row_id, row_number() OVER (PARTITION BY date ORDER BY coalesce(CASE WHEN k < 30 THEN k END, 1000000), CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END, row_id) AS new_rank FROM sched")
def w05(spark, d):
    s = programme(spark, d).select("row_id", "date", F.when(F.col("k") < 30, F.col("k")).alias("rank"), (F.col("k") % 2 == 0).alias("primary"), F.col("row_id").alias("pos"))
    return planning.day_ranks(s).select("row_id", big("new_rank").alias("new_rank"))


@query("w06_rank_errors", f"WITH {SCHED}, r AS (SELECT row_id, user_id AS pool_id, k - 5 AS rank FROM sched) SELECT row_id FROM (SELECT *, count(*) OVER (PARTITION BY pool_id, rank) AS n FROM r) WHERE rank < 1 OR n > 1")
def w06(spark, d):
    return planning.rank_errors(programme(spark, d).select("row_id", F.col("user_id").alias("pool_id"), (F.col("k") - 5).alias("rank"))).select("row_id")


@query("a28_classify", f"""WITH g AS (SELECT o_orderkey, o_orderkey % 11 = 0 AS paused, o_orderkey % 7 = 0 AS conflict, o_orderkey % 5 = 0 AS card, o_orderkey % 3 = 0 AS work, CAST(o_custkey % 4 AS INTEGER) AS prior FROM orders)
SELECT o_orderkey, CASE WHEN paused THEN 'paused' WHEN conflict THEN 'conflicted' WHEN card THEN 'materialised' WHEN work AND prior > 0 THEN 'reusable' ELSE 'new' END AS classification, CASE WHEN work THEN '' ELSE 'work,' END || 'image,summary' AS requirements FROM g""")
def a28(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    g = o.select("o_orderkey", (k % 11 == 0).alias("paused"), (k % 7 == 0).alias("conflict"), (k % 5 == 0).alias("has_card"), (k % 3 == 0).alias("has_work"), (F.col("o_custkey") % 4).alias("prior_weeks"), F.lit(False).alias("has_image"), F.lit(True).alias("has_rating"), F.lit(False).alias("has_summary"), F.lit(True).alias("has_evidence"))
    return planning.classify(g).select("o_orderkey", "classification", "requirements")


@query("a29_scope_deficits", f"""WITH {SCHED}, p AS (SELECT date, channel AS section, count(DISTINCT work_id) AS present FROM sched WHERE k < 40 GROUP BY ALL), r AS (SELECT DISTINCT date, channel AS section FROM sched) SELECT r.date, r.section, coalesce(present, 0) AS present, greatest(0, 12 - coalesce(present, 0)) AS deficit FROM r LEFT JOIN p USING (date, section)""")
def a29(spark, d):
    s = programme(spark, d).withColumnRenamed("channel", "section")
    req = s.select("date", "section").distinct().withColumn("target", F.lit(12))
    return planning.scope_deficits(req, s.where("k < 40")).select("date", "section", "present", "deficit")


@query("a34_guide_groups", """WITH RECURSIVE r AS (SELECT event_id % 500 AS slot, event_id // 500 AS j, event_type = 'signup' AS official, event_type <> 'error' AS proven FROM events),
g AS (SELECT DISTINCT slot, 'p' || j // 2 AS p, CASE WHEN proven THEN (j + 1) // 2 END AS feed FROM r WHERE NOT official),
e AS (SELECT DISTINCT a.slot, a.p, b.p AS q FROM g a JOIN g b ON a.slot = b.slot AND (a.p = b.p OR a.feed = b.feed)),
t AS (SELECT slot, p, p AS q FROM e UNION SELECT t.slot, t.p, e.q FROM t JOIN e ON e.slot = t.slot AND e.p = t.q),
c AS (SELECT slot, count(DISTINCT low) AS n FROM (SELECT slot, p, min(q) AS low FROM t GROUP BY slot, p) GROUP BY slot),
o AS (SELECT slot, bool_or(official) AS official FROM r GROUP BY slot)
SELECT slot, coalesce(n, 0) AS n_groups, official, concat_ws(',', CASE WHEN official THEN 'official' END, CASE WHEN n >= 2 THEN 'concordant' END) AS routes FROM o LEFT JOIN c USING (slot)""")
def a34(spark, d):
    """Chains of publishers, each sharing one feed with the last and one with the next; links without evidence and official sources break them."""
    j = F.floor(F.col("event_id") / 500)
    name = F.concat(F.when(j % 2 == 0, F.lit("P")).otherwise(F.lit(" p")), F.floor(j / 2).cast("string"))
    feed = F.concat(F.lit("feed "), F.floor((j + 1) / 2).cast("string"))
    r = table(spark, d, "events").select((F.col("event_id") % 500).alias("slot"), name.alias("publisher"), feed.alias("feed"), F.when(F.col("event_type") != "error", "seen").alias("evidence"), (F.col("event_type") == "signup").alias("official"))
    return planning.guide_groups(r)


@query("a35_overview", f"WITH {SCHED} SELECT title_key, max(k) AS best, count(DISTINCT (date, start_min, channel)) AS slots, max(date) AS latest, min(work_id) AS work_id FROM sched GROUP BY title_key")
def a35(spark, d):
    return planning.overview(programme(spark, d).withColumn("score", F.col("k")))


@query("a40_phase_spans", f"""WITH g AS (SELECT user_id AS session, event_type AS phase, min(ts) AS a, max(ts) AS b, count(*) AS n FROM events GROUP BY ALL) SELECT session, phase, n, CAST(floor(epoch(b)) - floor(epoch(a)) AS BIGINT) AS seconds, coalesce(a < max(b) OVER (PARTITION BY session ORDER BY a, phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overlaps FROM g""")
def a40(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("phase"), F.col("ts").cast("timestamp").alias("ts"))
    return planning.phase_spans(log).select("session", "phase", "n", "seconds", "overlaps")


@query("a13_completeness", """SELECT lang, count(*) AS n, CAST(floor(100.0 * count(quality) / count(*) + 0.5) AS BIGINT) AS labelled_pct, CAST(floor(100.0 * count(*) FILTER (quality = 1) / count(*) + 0.5) AS BIGINT) AS good_pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def a13(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return audits.ratio(j, ["lang"], labelled_pct=F.col("quality").isNotNull(), good_pct=F.col("quality") == 1)


@query("a17_duplicates", f"""WITH {SCHED}, {POOL}, {OCC}, w AS (SELECT p_partkey AS id, p_name AS title, p_size % 5 AS year, p_partkey // 2 AS legacy FROM part),
h AS (SELECT week, {KEY.format("title_key")} AS key FROM occ WHERE id % 50 = 1 OR qty > 49),
x AS (SELECT 'headliner' AS "check", week AS scope, key FROM h UNION ALL SELECT 'programme', CAST(date AS VARCHAR), title_key || '|' || channel || '|' || CAST(start_min // 30 AS VARCHAR) FROM sched UNION ALL SELECT 'work_id', '', CAST(id AS VARCHAR) FROM w
 UNION ALL SELECT 'work_title', '', {KEY.format("title")} || '|' || year || '|' FROM w UNION ALL SELECT 'legacy_id', '', 'l' || legacy FROM w WHERE legacy % 3 = 0 UNION ALL SELECT 'rank', CAST(pool_id AS VARCHAR), CAST(rank // 2 AS VARCHAR) FROM pool UNION ALL SELECT 'page_id', week, CAST(pool_id AS VARCHAR) FROM occ)
SELECT "check", scope, key, count(*) AS n FROM x GROUP BY ALL HAVING count(*) > 1""")
def a17(spark, d):
    """Titles of an issue, programme rows, works and their former ids, ranks of pools and pages of issues: what occurs twice."""
    occ, s, p = occurrences(spark, d), programme(spark, d), table(spark, d, "part")
    headliners = occ.where("id % 50 = 1 OR qty > 49").select("week", F.col("title_key").alias("title"))
    rows = s.select("date", "title", "channel", F.floor(F.col("start_min") / 30).cast("string").alias("start"))
    legacy = F.floor(F.col("p_partkey") / 2)
    catalogue = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (F.col("p_size") % 5).alias("year"), F.lit(None).cast("string").alias("kind"), F.when(legacy % 3 == 0, F.array(F.concat(F.lit("l"), legacy.cast("string")))).otherwise(F.array().cast("array<string>")).alias("legacy_ids"))
    pools = pool(spark, d).select("pool_id", F.floor(F.col("rank") / 2).alias("rank"))
    return audits.duplicates(headliners, rows, catalogue, pools, occ.select("week", F.col("pool_id").alias("page_id")))


@query("a18_template_fingerprints", f"""WITH {SCHED}, p AS (SELECT user_id, date, channel || ' ' || string_agg(start_min // 720, ',' ORDER BY ts) AS f FROM sched GROUP BY user_id, date, channel) SELECT user_id, f, count(*) AS days FROM p GROUP BY user_id, f HAVING count(*) >= 4""")
def a18(spark, d):
    """Half days of a channel as a user's template of a day."""
    s = programme(spark, d).withColumn("half", F.floor(F.col("start_min") / 720).cast("string"))
    s = s.groupBy("user_id", "date", "channel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "half"))), lambda x: x["half"]), ",").alias("times"))
    return s.groupBy("user_id", F.concat_ws(" ", "channel", "times").alias("f")).agg(F.count("*").alias("days")).where("days >= 4")


@query("f18_placeholders", r"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') || CASE turn % 5 WHEN 0 THEN ' AU-DESSUS du seuil éditorial de la semaine' WHEN 1 THEN ' Rubrique conservée ;  publication prudente' WHEN 2 THEN ' todo, à compléter' WHEN 3 THEN ' Retenu pour son intérêt cinématographique, sa singularité ou sa valeur patrimoniale.' ELSE '' END AS text FROM conversations)
SELECT conv_id, turn, regexp_matches(text, '(?i)rubrique conservée\s*;\s*publication prudente|au-dessus du seuil éditorial de la semaine|retenu après inventaire et filtre éditorial|retenu pour son intérêt cinématographique,\s*sa singularité ou sa valeur patrimoniale') AS placeholder FROM c""")
def f18(spark, d):
    c = table(spark, d, "conversations")
    more = F.element_at(F.array(*map(F.lit, (" AU-DESSUS du seuil éditorial de la semaine", " Rubrique conservée ;  publication prudente", " todo, à compléter", " Retenu pour son intérêt cinématographique, sa singularité ou sa valeur patrimoniale.", ""))), (F.col("turn") % 5 + 1).cast("int"))
    return c.select("conv_id", "turn", predicates.placeholder(F.concat(F.coalesce("text", F.lit("")), more)).alias("placeholder"))


@query("f22_admission", f"""WITH {SCHED} SELECT row_id, CASE WHEN k % 10 = 0 THEN 'title' WHEN k % 7 = 0 THEN 'start' WHEN date NOT BETWEEN DATE '2024-01-06' AND DATE '2024-01-12' THEN 'outside_week' END AS error FROM sched""")
def f22(spark, d):
    s = programme(spark, d)
    start = F.when(F.col("k") % 7 == 0, "25:00").otherwise("20:50")
    err = predicates.admission_error(F.when(F.col("k") % 10 != 0, F.col("title")), F.col("date"), start, F.col("channel"), F.lit("2024-01-06").cast("date"), F.lit("2024-01-12").cast("date"))
    return s.select("row_id", err.alias("error"))


@query("f24_missing_facts", "SELECT doc_id, concat_ws(',', CASE WHEN coalesce(trim(text), '') = '' THEN 'text' END, CASE WHEN lang IS NULL OR lang = 'en' THEN 'lang' END, CASE WHEN source IS NULL THEN 'source' END, CASE WHEN n_chars <= 500 THEN 'long' END) AS missing FROM documents")
def f24(spark, d):
    """Documents with the facts they lack; English ones and short ones count as lacking."""
    docs = table(spark, d, "documents")
    facts = {"text": F.col("text"), "lang": F.when(F.col("lang") != "en", F.col("lang")), "source": F.col("source"), "long": F.when(F.col("n_chars") > 500, F.col("n_chars").cast("string"))}
    return docs.select("doc_id", F.array_join(predicates.missing_facts(facts), ",").alias("missing"))


@query("a33_gap_totals", """WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, CAST(o_orderdate AS DATE) - DATE '1995-03-04' AS ahead, CASE WHEN o_orderstatus = 'O' THEN 'blocking' ELSE 'warning' END AS severity FROM orders),
s AS (SELECT severity, CASE k WHEN 0 THEN 'coverage:lundi' WHEN 1 THEN 'coverage' WHEN 2 THEN 'rubrique:radar-du-jour' WHEN 3 THEN 'day:vendredi' WHEN 4 THEN 'deliverable' WHEN 5 THEN 'global' WHEN 6 THEN 'day:samedi'
 ELSE CASE WHEN ahead BETWEEN 0 AND 6 THEN 'day:' || ['samedi', 'dimanche', 'lundi', 'mardi', 'mercredi', 'jeudi', 'vendredi'][CAST(ahead + 1 AS INTEGER)] ELSE 'global' END END AS scope FROM o)
SELECT scope, severity, count(*) AS n FROM s GROUP BY ALL""")
def a33(spark, d):
    """What validators print of a customer's orders, a line each between lines that are no problems."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    text = F.element_at(F.array(
        F.lit("Inventaire de Lundi incomplet"), F.lit("chaînes manquantes"), F.lit("page RADAR-du-jour sans carte, mercredi"), F.concat(F.lit("vendredi: "), key, F.lit(" sans image")), F.lit("Hero image missing"),
        F.concat(F.lit("lundis "), key), F.lit("samedi-selection sans rang"), F.concat(F.lit("le "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" sans visuel")),
    ), (F.col("o_orderkey") % 8 + 1).cast("int"))
    line = F.concat(F.when(F.col("o_orderstatus") == "O", "  ✗ ").otherwise("! "), text)
    printed = o.groupBy("o_custkey").agg(F.array_join(F.concat(F.collect_list(line), F.array(F.lit("✗ gate failed: 3 problems"), F.lit("ok"))), "\r\n").alias("output"))
    return planning.gap_totals(planning.problem_lines(printed), F.lit("1995-03-04").cast("date"), ["samedi-selection", "radar-du-jour"])