"""Operators on small frames, sources and sinks by round trip, streams against their batch form."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import consensus, identity, personal, planning, schedule
from gridloom.sources import captures, documents, sinks
from gridloom.streaming import jobs, tables


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_flatten_sources(spark, tmp_path):
    inv = {"week": "2024-S01", "days": [{"date": "2024-01-06", "items": [{"title": "A", "start": "20:50", "channel": "x"}, {"title": "B", "start": "00:10", "channel": "x"}]}]}
    (tmp_path / "inv.json").write_text(json.dumps(inv))
    df = spark.read.schema(documents.INVENTORY_SCHEMA).json(f"{tmp_path}/inv.json")
    assert rows(documents.inventory_rows(df), "pos", "title") == [(0, "A"), (1, "B")]
    issue = {"week": "2024-S01", "personalization": {"pools": {"p1": {"page_id": "g", "target": 1, "candidates": [{"title": "A", "rank": 1}, {"title": "B", "rank": 2}]}}}}
    (tmp_path / "issue.json").write_text(json.dumps(issue))
    assert rows(documents.pool_rows(spark.read.schema(documents.ISSUE_SCHEMA).json(f"{tmp_path}/issue.json")), "pool_id", "pos", "title") == [("p1", 0, "A"), ("p1", 1, "B")]
    manifest = spark.createDataFrame([("2024-S01", "published"), ("2024-S02", "draft")], "week string, status string")
    assert documents.issues(spark, f"{tmp_path}/issue.json", manifest).count() == 1
    radar = {"week": "w", **{k: {"target": 1, "candidates": [{"title": k}]} for k in ("popular_scan", "popular_deep", "hd1", "hd2")}}
    (tmp_path / "radar.json").write_text(json.dumps(radar))
    assert len(rows(documents.radar_rows(spark.read.schema(documents.RADAR_SCHEMA).json(f"{tmp_path}/radar.json")), "pool_id")) == 4
    reg = spark.sql("SELECT map('T', map('imdb', 'u')) AS links")
    assert rows(documents.link_rows(reg)) == [("T", "imdb", "u")]
    (tmp_path / "w.json").write_text(json.dumps({"id": "a", "title": "A", "year": 1990, "links": {"imdb": "x"}}))
    assert rows(documents.works(spark, f"{tmp_path}/w.json"), "id", "year") == [("a", "1990")]
    (tmp_path / "dossier.json").write_text(json.dumps({"hd": [{"query": "q"}], "popularity": [{"query": "r"}]}))
    assert rows(documents.dossier_rows(spark, f"{tmp_path}/dossier.json", ["hd", "popularity"], "struct<query:string>"), "_key", "query") == [("hd", "q"), ("popularity", "r")]


def test_capture_layouts(spark):
    cap = spark.createDataFrame([("c", "arte", datetime.date(2024, 1, 6), "")], "capture_id string, channel string, date date, body string")
    body = '<article data-start="2024-07-01T22:30:00Z"><h3>T</h3></article>'
    assert rows(captures.offset_layout(cap.withColumn("body", F.lit(body))), "date", "start_min", "title") == [(datetime.date(2024, 7, 2), 30, "T")]
    xml = "<r><diffusion><date>2024-01-06</date><heure>10:00</heure><titre> X </titre></diffusion><diffusion><date>2024-01-06</date><heure>11:00</heure><titre>Y</titre></diffusion></r>"
    assert rows(captures.xml_layout(cap.withColumn("body", F.lit(xml))), "start_min", "title") == [(600, "X"), (660, "Y")]
    got, pages = captures.json_layout(cap.withColumn("body", F.lit('{"page":1,"total_pages":2,"total_products":3,"products":[{"title":"J","start":"08:00"}]}')))
    assert rows(got, "start_min", "title") == [(480, "J")] and rows(schedule.pagination_gaps(pages), "missing", "total_differs") == [("2", True)]
    page = '<html lang="fr"><title>t &amp; u</title><script type="application/ld+json">{"@graph":[{"name":"N","duration":"PT1H"}]}</script></html>'
    facts = captures.page_facts(spark.createDataFrame([(1, page)], "page_key int, html string"))
    assert rows(facts, "fact", "value") == [("lang", "fr"), ("ld:duration", "PT1H"), ("ld:name", "N"), ("title", "t & u")]


def test_guide_pages(spark):
    day, url = datetime.date(2024, 1, 6), "https://www.guide.example/fr/guide/20240106/"
    li = lambda t, n: f'<LI data-testid="tsguide-itm"><span>{t}</span><a data-testid="ts-tsItemLink" href="/fr/videos/{n}/"><h3 data-testid="ts-tsTitle">{n}</h3></a></LI>'
    page = lambda body, at=url: f'<link rel="canonical" href="{at}">' + body
    bodies = {
        "good": page(li("20:50", "a") + li("23:30", "b") + li("01:10", "c") + li("04:00", "d")), "twice": page(li("22:00", "a") + li("01:00", "b") + li("00:30", "c") + li("02:00", "d")),
        "early": page(li("04:30", "a") + li("12:00", "b") + li("05:30", "c") + li("13:00", "")), "other": page(li("20:50", "a"), url + "x"), "empty": page(""), "null": None,
        "bot": page(li("20:50", "a") + "<p>Verify you are <b>human</b></p>"), "cut": page(li("20:50", "a") + li("21:50", "b")[:-6]), "script": page("<script>just a moment</script>" + li("20:50", "a")),
    }
    cap = spark.createDataFrame([(k, url, "arte", day, b) for k, b in bodies.items()], "capture_id string, url string, channel string, date date, body string")
    good, bad = captures.rejected(captures.guide_list(cap, captures.BROADCASTER_GUIDE), F.col("error"))
    next_day = day + datetime.timedelta(days=1)
    assert rows(good, "capture_id", "date", "start_min", "title") == sorted([
        ("cut", day, 1250, "a"), ("early", day, 720, "b"), ("good", day, 1250, "a"), ("good", day, 1410, "b"), ("good", next_day, 70, "c"), ("good", next_day, 240, "d"),
        ("script", day, 1250, "a"), ("twice", day, 1320, "a"), ("twice", next_day, 120, "d"), ("twice", next_day, 60, "b"),
    ], key=repr)
    assert {tuple(x) for x in bad.select("capture_id", "row", "reason").collect()} == {
        ("twice", 2, "second_rollover"), ("early", 0, "first_time"), ("early", 2, "implausible_order"), ("early", 3, "title_missing"), ("other", None, "canonical_mismatch"), ("empty", None, "no_rows"),
        ("null", None, "canonical_mismatch"), ("bot", None, "unavailable_page"), ("cut", None, "truncated_rows 1 of 2"),
    }
    assert {x.link for x in good.collect()} == {f"https://www.guide.example/fr/videos/{n}/" for n in "abcd"}


def test_quarantined_works(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id":"a","title":"A","links":{"imdb":"1"}}\n\n{"id":"b", broken\n{"title":"nameless"}\n')
    (tmp_path / "in" / "b.json").write_text('not json\n{"id":"c","aliases":["x","y"],"unknown":1}\n')
    assert documents.quarantine_works(spark, f"{tmp_path}/in", f"{tmp_path}/out") == {"works": 2, "rejected": 3}
    assert rows(documents.kept_works(spark, f"{tmp_path}/out"), "id", "aliases") == [("a", None), ("c", ["x", "y"])]
    bad = {(r["file"].rpartition("/")[2], r["block"], r["line"], r["text"]) for r in documents.rejected_works(spark, f"{tmp_path}/out").collect()}
    assert bad == {("a.json", 0, 2, '{"id":"b", broken'), ("a.json", 0, 3, '{"title":"nameless"}'), ("b.json", 0, 0, "not json")}


def test_sinks_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert sinks.append(f"{tmp_path}/t", df, ["k"]) == 2
    assert sinks.append(f"{tmp_path}/t", df, ["k"]) == 0
    assert sinks.append(f"{tmp_path}/t", spark.createDataFrame([(3, "c")], "k int, v string"), ["k"]) == 1
    sinks.watch_list_csv(df, f"{tmp_path}/csv")
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "csv").glob("part-*"))
    assert '"1";"a"' in text
    first = min((tmp_path / "csv").glob("part-*")).read_bytes()
    assert first.startswith(b"\xef\xbb\xbf\"k\";\"v\"")


def test_upsert_and_fill(spark):
    mk = lambda r: spark.createDataFrame(r, "id string, title string, links map<string,string>")
    cat, plan = mk([("a", "A", {"imdb": "1"}), ("b", "B", None)]), mk([("a", "A2", {"imdb": "2", "tmdb": "3"}), ("c", "C", {"imdb": "9"})])
    out, bad = consensus.upsert_works(cat, plan)
    got = {r["id"]: (r["title"], dict(r["links"])) for r in out.collect()}
    assert got == {"a": ("A", {"imdb": "1", "tmdb": "3"}), "b": ("B", {}), "c": ("C", {"imdb": "9"})} and rows(bad) == [("a", "imdb", "1", "2")]
    again, _ = consensus.upsert_works(out, plan)
    assert {r["id"]: (r["title"], dict(r["links"])) for r in again.collect()} == got


def test_consensus(spark):
    f = spark.createDataFrame([(1, "director", "s1", 1, "Ann, Bob"), (1, "director", "s2", 2, "Bob & Ann"), (1, "genre", "s1", 1, "drama, noir"), (1, "genre", "s2", 2, "noir"), (2, "country", "s1", 1, "France"), (2, "country", "s2", 2, "Italie")], "work_id int, field string, source string, ladder int, value string")
    got = {(r["work_id"], r["field"]): (r["value"], r["status"]) for r in consensus.merge_facts(f, {"director": "set", "genre": "share"}).collect()}
    assert got == {(1, "director"): ("Ann, Bob", "agreed"), (1, "genre"): ("drama, noir", "agreed"), (2, "country"): (None, "conflict")}
    p = spark.createDataFrame([("w", "u1", "h1", 1, False, True), ("w", "u2", "h1", 2, True, False), ("w", "u3", "h2", 3, True, False), ("w", "u4", "h1", 4, True, False)], "work_id string, url string, host string, ladder int, ok boolean, is_primary boolean")
    assert rows(consensus.image_decision(p)) == [("w", "repair", "u2", "u3,u4")]


def test_library_and_best_match(spark):
    items = spark.createDataFrame([(1, "Mr Smith", "tt1", None, 2000, None), (2, "Dr No", None, None, 1962, None), (3, "Dr No", None, None, 1963, None), (4, "The Very Long Title Indeed Extended", None, None, None, None), (5, "None", None, None, None, None)], "row_id int, title string, imdb string, tmdb string, year int, director string")
    lib = spark.createDataFrame([("a", "x", "tt1", None, 1999), ("b", "Doctor No", None, None, 1962), ("c", "The Very Long Title Indeed", None, None, 1980)], "lib_id string, name string, imdb string, tmdb string, year int")
    assert rows(identity.library_match(items, lib), "row_id", "basis", "candidate") == [(1, 1, "a"), (2, 3, "b"), (3, 3, "b"), (4, 4, "c"), (5, None, None)]
    cand = spark.createDataFrame([("k1", "tt1", "z", "d", 1950), ("k2", None, "Dr No", "d", 1962)], "cand_id string, imdb string, title string, director string, year int")
    # a title alone gives 85, its year 40, the next year 8; a wrong year or director counts against it
    assert rows(identity.best_match(items, cand)) == [(2, "k2", 125), (3, "k2", 93)]
    assert rows(identity.best_match(items, cand, "browser")) == [(1, "k1", 1000), (2, "k2", 220), (3, "k2", 170)]
    one = spark.createDataFrame([(1, "Dr No", None, 1962, "Terence Young"), (2, "Dr No Returns", None, 1980, "Terence Young"), (3, "The Dr No File", None, 1962, "Young")], "row_id int, title string, imdb string, year int, director string")
    cand = spark.createDataFrame([("k", None, "Dr No", "Terence Young", 1962), ("wrong", None, "Dr No", "Terence Young", 1990)], "cand_id string, imdb string, title string, director string, year int")
    assert rows(identity.best_match(one, cand)) == [(1, "k", 160), (3, "k", 120)]
    middle = spark.createDataFrame([(1, "Tonight The Very Long Title Indeed Again", None, None, None)], "row_id int, title string, imdb string, tmdb string, year int")
    assert rows(identity.library_match(middle, lib), "row_id", "basis", "candidate") == [(1, 4, "c")]
    years = spark.createDataFrame([(1, "Dr No", None, None, 1970), (2, "Dr No", None, None, None), (3, "Twice", None, None, 1990), (4, "The Very Long Title Indeed", None, None, 1970), (5, "Undated", None, None, 1990)], "row_id int, title string, imdb string, tmdb string, year int")
    more = lib.unionByName(spark.createDataFrame([("d", "Twice", None, None, 1990), ("e", "Twice", None, None, 1990), ("f", "Undated", None, None, None)], lib.schema))
    # a wrong year refuses equal names and contained ones; several of the year end the search
    assert rows(identity.library_match(years, more), "row_id", "basis", "candidate") == [(1, None, None), (2, 3, "b"), (3, None, None), (4, None, None), (5, 3, "f")]


def join_rows(df):
    """Rows that each join of the executed plan gave."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(p.executedPlan())
        if "Join" in name:
            out.append(p.metrics().apply("numOutputRows").value())
        children = [p.plan()] if "QueryStage" in name else [p.children().apply(i) for i in range(p.children().size())]
        for c in children:
            walk(c)

    walk(plan)
    return out


def test_ladders_join_one_to_one(spark):
    """A slot with n rows on both sides makes n rows, not n times n."""
    s = spark.range(400).selectExpr("id AS row_id", "'d' AS date", "1 AS start_min", "'c' AS channel", "concat('t', id % 3) AS title_key")
    r = s.withColumnRenamed("row_id", "review_id").withColumn("reviewed_key", F.lit(None).cast("string"))
    evidence = identity.schedule_evidence(s.select(F.col("row_id").alias("cand_id"), "title_key", "channel", "start_min", F.lit(1).alias("rank"), F.lit(1).alias("target")), s)
    seeds = planning.initial_seeds(s.select(F.col("row_id").alias("signal_id"), "title_key", "date", F.lit(3).alias("score")), s.select(F.col("row_id").alias("group_id"), "title_key", "date", F.lit(True).alias("open")))
    for df in (identity.review_ladder(s, r), identity.slot_ladder(s, s), evidence, seeds):
        joins = join_rows(df)
        assert joins and max(joins) <= 400 and df.count() == 400


def test_phrases_are_whole(spark):
    texts = spark.createDataFrame([(1, "The big, red dog. The big dog!"), (2, "the big red cat the red dog"), (3, None), (4, ""), (5, "dog"), (6, "a a a b")], "text_id int, text string")
    names = spark.createDataFrame([("x", "Big red dog"), ("y", "the big"), ("z", "Dog"), ("w", "big dog the"), ("v", ""), ("u", None), ("t", "a a b"), ("s", "a a a a"), ("z", "cat")], "name_id string, name string")
    assert rows(identity.phrase_containment(texts, names.where("name <> 'cat'"))) == [(1, "x"), (1, "y"), (1, "z"), (2, "y"), (2, "z"), (5, "z"), (6, "t")]


def test_named_lookup_pairs_once(spark):
    """Repeated rows and evidence give a pair once, nulls match nothing, and the pairs themselves are not shuffled."""
    obs = spark.createDataFrame([(1, "t"), (1, "t"), (2, "t"), (None, "u"), (3, None)], "work_id int, title_key string")
    ev = spark.createDataFrame([(1, "x", 5), (1, "x", 5), (1, "x", 6), (None, "t", 7), (None, "t", 7), (2, "t", 8), (None, None, 9), (None, "u", 9)], "e_work_id int, e_title_key string, e int")
    found = identity.named_lookup(obs, ev)
    assert sorted((r["work_id"] or 0, r["title_key"], r["e"]) for r in found.collect()) == [(0, "u", 9), (1, "t", 5), (1, "t", 6), (1, "t", 7), (2, "t", 7), (2, "t", 8)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")


def test_joins_have_no_nested_loops(spark):
    obs = spark.createDataFrame([(1, "t", "d", "c")], "work_id int, title_key string, date string, channel string")
    ev = spark.createDataFrame([(1, None, 5)], "e_work_id int, e_title_key string, e int")
    rec = spark.createDataFrame([("t", None, "c", "dynamic")], "r_title_key string, r_date string, r_channel string, stability string")
    cards = spark.createDataFrame([(1, 2, "T")], "user_id int, work_id int, title string")
    for df in (identity.named_lookup(obs, ev), identity.scoped_records(rec, obs), identity.without_seen(cards, cards)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_personal(spark):
    cards = spark.createDataFrame([(1, "p", w, f"t{w}", r, 2, w != 4) for w, r in ((1, 1), (2, 2), (4, 3), (5, 4))], "user_id int, pool_id string, work_id int, title string, rank int, target int, eligible boolean")
    seen = spark.createDataFrame([(1, 1, None)], "user_id int, work_id int, title string")
    assert rows(personal.visible(cards, seen), "work_id", "slot") == [(2, 1), (5, 2)]
    lib = spark.createDataFrame([(1, "p", 1, 1, 2, True, True), (1, "p", 2, 2, 2, False, True), (1, "p", 3, 3, 2, False, False)], "user_id int, pool_id string, work_id int, rank int, target int, played boolean, resolved boolean")
    assert rows(personal.library_row(lib), "work_id", "slot") == [(1, 2), (2, 1)]
    more = spark.createDataFrame([(1, 9, "t9", 1)], "user_id int, work_id int, title string, pos int")
    assert rows(personal.grid_refill(more.withColumn("work_id", F.lit(1)), seen, more, 3), "work_id", "slot", "page") == [(9, 1, 1)]


def plain_claims(follows, pools, seen):
    """Pages filled one after the other, as a reader's browser would."""
    out = []
    for user, family in sorted(set(follows)):
        pages = {}
        for f, page, work, rank, target, eligible in sorted(pools, key=lambda r: (r[3], r[2])):
            if f == family:
                pages.setdefault(page, []).append((work, rank, target, eligible))
        gone = {w for u, w in seen if u == user}
        claimed = {w for cards in pages.values() for w, r, t, _ in cards if r <= t and w not in gone}
        for page, cards in sorted(pages.items()):
            shown = [w for w, r, t, _ in cards if r <= t and w not in gone]
            for w, r, t, ok in cards:
                if r > t and ok and len(shown) < t and w not in gone and w not in claimed:
                    claimed.add(w)
                    shown.append(w)
            out += [(user, family, page, w, i + 1) for i, w in enumerate(shown)]
    return sorted(out)


def test_family_claims(spark):
    r = random.Random(2)
    pools = [(f, p, w, k + 1, 3, r.random() < 0.8) for f in range(3) for p in range(4) for k, w in enumerate(r.sample(range(30), 18))]
    follows = [(u, r.randrange(3)) for u in range(25) for _ in range(2)] + [(None, 1), (3, None), (4, 9)]
    seen = [(u, w) for u in range(20) for w in r.sample(range(30), u)] + [(1, None), (None, 2)]
    got = personal.family_claims(
        spark.createDataFrame(follows, "user_id int, family int"), spark.createDataFrame(pools, "family int, page_pos int, work_id int, rank int, target int, eligible boolean"), spark.createDataFrame(seen, "user_id int, work_id int")
    )
    assert sorted((tuple(x) for x in got.where("user_id IS NOT NULL").select("user_id", "family", "page_pos", "work_id", "slot").collect())) == plain_claims([f for f in follows if None not in f], pools, seen)


def test_cards_are_bounded(spark):
    """What is joined of a pool grows with what its users have seen, not with the pool."""
    pools = spark.range(20_000).selectExpr("1 AS pool_id", "cast(id AS int) AS work_id", "concat('t', id) AS title", "cast(id + 1 AS int) AS rank", "5 AS target", "true AS eligible")
    asked = spark.createDataFrame([(u, 1, 7) for u in range(50)], "user_id int, pool_id int, upto int")
    assert personal.first_cards(asked, pools.withColumn("place", F.col("rank")), ["pool_id"]).count() == 50 * 7
    follows, seen = asked.select("user_id", "pool_id"), spark.createDataFrame([(1, 0, None), (1, None, "t1")], "user_id int, work_id int, title string")
    df = personal.visible_cards(follows, pools, seen)
    assert rows(df.where("user_id = 1"), "work_id", "slot") == [(2, 1), (3, 2), (4, 3), (5, 4), (6, 5)] and df.count() == 250


def test_planning(spark):
    chain = [(1, f"{'P' if i % 2 else 'p'}{i}", f"f{j}", "e", False) for i in range(20) for j in (i, i + 1)]
    g = [(2, "a", "f", None, False), (2, "b", "f", "", False), (3, "A ", None, None, False), (3, "a", None, None, False), (4, "x", "f", "e", True), (4, None, "f", "e", False), (5, "x", "f", "e", True), (5, "y", "f", "e", False), (5, "z", "f", "e", False), (5, "w", None, None, None)]
    reports = spark.createDataFrame(chain + g, "slot int, publisher string, feed string, evidence string, official boolean")
    assert rows(planning.guide_groups(reports)) == [(1, 1, False, ""), (2, 2, False, "concordant"), (3, 1, False, ""), (4, 0, True, "official"), (5, 2, True, "official,concordant")]
    scope = planning.gap_scope(F.col("m"), F.lit("2024-01-06").cast("date"), ["hd1", "mardi-selection"])
    messages = ["Inventory 2024-01-08 short", "HD1 trop court mardi", "mardi-selection: 2", "2024-01-12 sans carte", "2024-01-13 sans carte", "Shell absent", None]
    got = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "i int, m string").select("i", scope.alias("s")).select("i", "s.*")
    assert rows(got) == [(0, "coverage", "lundi"), (1, "rubrique", "hd1"), (2, "day", "mardi"), (3, "day", "vendredi"), (4, "global", None), (5, "deliverable", None), (6, "global", None)]
    gaps = spark.createDataFrame([(0, "Dimanche reserve too shallow without shortage_reason", "warning", None), (1, "dimanche-selection: 4 candidats (< 10) et shortage_reason non structuré", "blocking", None), (2, "odd", "warning", "day"), (3, "odd", "warning", None), (4, None, "warning", None)], "pos int, message string, severity string, scope string")
    assert rows(planning.task_board(gaps), "action", "kind", "blocking", "n") == [("daily-reserve-dimanche", "day", True, 2), ("observation-2", "day", False, 1), ("observation-3", "global", False, 1), ("observation-4", "global", False, 1)]
    old = spark.createDataFrame([("p", 1, 1), ("p", 2, 2)], "pool_id string, work_id int, rank int")
    assert rows(planning.append_contract(old, spark.createDataFrame([("p", 3, 3), ("p", 2, 4)], "pool_id string, work_id int, rank int"))) == [("p", True, 1, True)]
    picks = spark.createDataFrame([(1, "A", None), (2, "A", None), (3, "B", 7), (4, "C", None), (5, "D", None)], "pick_pos int, title string, work_id int")
    works = spark.createDataFrame([(1, "C"), (2, "C")], "id int, title string")
    dossiers = spark.createDataFrame([("A", 1990), ("D", None)], "title string, year int")
    assert rows(identity.pick_plan(picks, works, dossiers), "pick_pos", "status") == [(1, "dossier"), (2, "repeat"), (3, "explicit"), (4, "clash"), (5, "needs_year")]


def run_stream(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(90)
    q.stop()
    return spark.table(name)


@pytest.fixture()
def event_stream(spark, sf_dir, tmp_path):
    src = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id").orderBy("ts").limit(400)
    src.coalesce(1).write.parquet(f"{tmp_path}/ev")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark.readStream.schema(spark.read.parquet(f"{tmp_path}/ev").schema).parquet(f"{tmp_path}/ev"), spark.read.parquet(f"{tmp_path}/ev")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stream_recent_topics(spark, event_stream):
    stream, batch = event_stream
    shape = lambda df: df.select(F.col("ts").alias("activity_at"), F.col("user_id").alias("topic_id"), F.col("event_type").alias("title"))
    got = run_stream(spark, jobs.recent_topics(shape(stream), 24), "recent_topics", "append")
    now = batch.agg(F.max("ts")).first()[0]
    want = shape(batch).where(F.col("activity_at") >= F.lit(now) - F.expr("INTERVAL 24 HOURS")).groupBy(F.col("topic_id").cast("string").alias("k")).agg(F.max("activity_at").alias("at"))
    assert rows(jobs.current(got, F.lit(now), 24), "k", "at") == rows(want, "k", "at") != []


def test_stream_match_cache(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    batches = [
        [("a", at(0), "1", True), ("b", at(0), "2", True), ("c", at(1), "3", True), ("d", at(1), "4", True)],
        [("b", at(2), None, False), ("a", at(3), "5", True), ("d", at(0.5), "9", True)],  # b is no longer found, a is found anew, an older d comes late
        [("e", at(12), "6", True)],
        [("f", at(40), None, False), ("g", at(40), "7", True), ("c", at(39.5), "8", True)],
    ]
    schema = "k string, ts timestamp, match_id string, found boolean"
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    emitted = run_stream(spark, jobs.match_cache(stream, 10), "match_cache", "append")
    shown = lambda h: rows(jobs.current(emitted, F.lit(at(h)), 10), "k", "value")
    assert shown(12) == [("a", "5"), ("e", "6")]  # c and d are eleven hours old
    assert shown(40) == [("c", "8"), ("g", "7")]


def plain_status(actions):
    on, status = False, None
    for _, _, a in sorted(actions):
        if a in ("seen", "unseen", "toggle"):
            on = not on if a == "toggle" else a == "seen"
        else:
            on, status = False, a
    return "vu" if on else status, status if on else None


def test_seen_status_of_late_and_shuffled_batches(spark, tmp_path):
    r = random.Random(5)
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    schema = "user_id long, k string, ts timestamp, event_id long, action string"
    actions = [(r.randrange(3), f"k{r.randrange(3)}", at(3 * i), i, r.choice(["seen", "unseen", "toggle", "toggle", "a", "b"])) for i in range(200)]
    shuffled = [a for n in range(0, 200, 20) for a in r.sample(actions[n : n + 20], 20)]  # at most an hour out of order
    end = [(9, "end", at(5000), 999, "seen")]
    for n in range(0, 200, 15):
        spark.createDataFrame(shuffled[n : n + 15], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03}")
    spark.createDataFrame(end, schema).coalesce(1).write.parquet(f"{tmp_path}/in/999")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    emitted = run_stream(spark, jobs.seen_state(stream, "70 minutes"), "seen_state", "append")
    last = emitted.groupBy("user_id", "k").agg(F.max_by(F.struct("status", "previous_status"), F.struct("ts_us", "event_id")).alias("s")).select("user_id", "k", "s.*")
    by = {}
    for u, k, t, i, a in actions:
        by.setdefault((u, k), []).append((t, i, a))
    want = sorted(((*key, *plain_status(v)) for key, v in by.items()), key=repr)
    assert rows(last) == want and emitted.count() == 200
    assert rows(personal.seen_status(spark.createDataFrame(actions, schema)).drop("seen")) == want


def test_capture_ages(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    schema = "source_key string, fetched_at timestamp, capture_id long, ok boolean"
    captures = [("a", 0, True), ("a", 5, True), ("b", 1, False), ("b", 2, False), ("b", 3, True), ("b", 4, False), ("c", 0, True), ("c", 13, False), ("c", 14, True), ("d", 0, True), ("d", 60, True), ("end", 200, True)]
    for n, (s, h, ok) in enumerate(captures):
        spark.createDataFrame([(s, at(h), n, ok)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n:02}")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    got = run_stream(spark, jobs.capture_ages(stream, 10, 20), "ages", "append")
    want = [("a", 0, "fresh"), ("a", 5, "fresh"), ("a", 15, "expired"), ("a", 25, "stale"), ("b", 1, "failed"), ("b", 3, "fresh"), ("b", 4, "stale"), ("c", 0, "fresh"), ("c", 10, "expired"), ("c", 13, "stale"), ("c", 14, "fresh"), ("c", 24, "expired"), ("c", 34, "stale"), ("d", 0, "fresh"), ("d", 10, "expired"), ("d", 20, "stale"), ("d", 60, "fresh"), ("d", 70, "expired"), ("d", 80, "stale")]
    assert rows(got) == sorted(((s, at(h), x) for s, h, x in want), key=repr)


def plain_import(observations, first, days):
    """One observation after the other."""
    norm = lambda s: s.lower().replace("é", "e")
    last, seen, taken, out = first + datetime.timedelta(days=days - 1), set(), {}, []
    stale = {}
    for date, start, channel, title, url, status, _ in observations:
        stale.setdefault((url, channel, date, start, norm(title)), []).append(status == "stale")
    for date, start, channel, title, url, _, _ in observations:
        slot, event = (date, norm(channel), start), (date, norm(channel), start, norm(title))
        row = (date, start, channel, title, url)
        if all(stale[url, channel, date, start, norm(title)]):
            out.append((*row, "excluded", "stale_source_after_failed_refresh", None))
        elif date is None or not first <= date <= last:
            out.append((*row, "excluded", "outside_the_week", None))
        elif event in seen:
            out.append((*row, "duplicate", None, None))
        elif slot in taken:
            out.append((*row, "conflict", None, [taken[slot]]))
        else:
            seen.add(event)
            taken[slot] = title
            out.append((*row, "added", None, None))
    return sorted(out, key=repr)


def import_rows(r, n, k):
    day = lambda i: datetime.date(2024, 1, 5) + datetime.timedelta(days=i)
    return [(r.choice([day(i) for i in range(9)] + [None]), r.choice(["20:00", "21:00"]), r.choice(["TF1", "Tf1", "Arte"]), r.choice(["Été", "ete", "Nuit", ""]), r.choice("xy"), r.choice(["parsed", "stale", "partial", "stale"]), 1000 * k + i) for i in range(n)]


def test_import_survives_a_crash(spark, tmp_path, monkeypatch):
    r, first = random.Random(9), datetime.date(2024, 1, 6)
    schema = "date date, start string, channel string, title string, source_url string, status string, pos int"
    batches = [import_rows(r, 60, k) for k in range(3)]
    # staleness is told within an import, so that pages of their own keep the plain version comparable
    batches = [[(*o[:4], f"{o[4]}{k}", *o[5:]) for o in b] for k, b in enumerate(batches)]
    frames = [spark.createDataFrame(b, schema) for b in batches]
    root, days = f"{tmp_path}/imported", F.lit(first).cast("date")

    def crashing():
        yield from ("added", "duplicate")
        raise OSError("lost")

    def state():
        return sorted((tuple(x[c] for c in (*tables.OBSERVATION, "o", "reason", "saved_titles")) for name in tables.OUTCOMES for x in tables.committed(spark, root, name, tables.IMPORTED).withColumn("o", F.lit(name)).collect()), key=repr)

    tables.import_batch(frames[0], 0, root, days)
    before = state()
    assert before == plain_import(batches[0], first, 7)
    with monkeypatch.context() as m:
        m.setattr(tables, "OUTCOMES", crashing())
        with pytest.raises(OSError):
            tables.import_batch(frames[1], 1, root, days)
    assert state() == before  # two tables are written, none counts
    tables.import_batch(frames[1], 1, root, days)
    tables.import_batch(frames[1].limit(3), 1, root, days)  # committed: passed over
    tables.import_batch(frames[2], 2, root, days)
    assert state() == plain_import(sum(batches, []), first, 7)
    tables.import_batch(frames[2].limit(0), 3, root, days)
    assert state() == plain_import(sum(batches, []), first, 7)


def test_upserts(spark, tmp_path, monkeypatch):
    r, root, schema = random.Random(4), f"{tmp_path}/topics", "k string, at int, value string"
    held = {}
    for n in range(5):
        batch = [(r.choice("abcdefgh") if n != 3 else "a", r.randrange(100), f"v{n}.{i}") for i in range(6)]
        batch = list({b[:2]: b for b in batch}.values())
        df = spark.createDataFrame(batch if n != 2 else [], schema)
        if n == 4:  # lost after the rows were written, before the commit
            with monkeypatch.context() as m:
                m.setattr(tables, "_pointer", lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError):
                    tables.upsert_batch(df, n, root, ["k"], ["at"], 4)
        before = rows(tables.upserted(spark, root, schema), "k", "at")
        tables.upsert_batch(df, n, root, ["k"], ["at"], 4)
        tables.upsert_batch(df, n, root, ["k"], ["at"], 4)
        assert rows(tables.upserted(spark, root, schema, before=n), "k", "at") == before
        for k, at, _ in batch if n != 2 else []:
            held[k] = max(held.get(k, 0), at)
        assert rows(tables.upserted(spark, root, schema), "k", "at") == sorted(held.items(), key=repr)
    tables.forget_versions(spark, root)
    tables.upsert_batch(spark.createDataFrame([("a", 999, "z")], schema), 5, root, ["k"], ["at"], 4)
    assert rows(tables.upserted(spark, root, schema), "k", "at") == sorted((held | {"a": 999}).items(), key=repr)


def test_best_match_of_equal_titles_meets_by_kinds(spark):
    """Rows of a title that recurs n times on both sides never make n times n pairs."""
    n = 500
    items = spark.range(n).selectExpr("id AS row_id", "if(id % 2 = 0, 'Dr No', 'The Dr No File') AS title", "cast(null AS string) AS imdb", "cast(1960 + id % 3 AS int) AS year", "if(id % 5 = 0, 'Young', 'Hunt') AS director")
    cand = spark.range(n).selectExpr(f"{n} - id AS cand_id", "cast(null AS string) AS imdb", "'Dr No' AS title", "if(id % 7 = 0, 'Hunt', 'Terence Young') AS director", "cast(1962 + id % 2 AS int) AS year")
    df = identity.best_match(items, cand)
    assert max(join_rows(df)) <= n
    best = {}
    for c in cand.collect():
        for kind in {(t, y, d) for t in ("Dr No", "The Dr No File") for y in (1960, 1961, 1962) for d in ("Young", "Hunt")}:
            t, y, d = kind
            score = (85 if t == "Dr No" else 45) + {0: 40, 1: 8}.get(abs(y - c["year"]), -80) + (35 if d in c["director"] else -20)
            if score >= 70:
                best[kind] = min(best.get(kind, (0, 0)), (-score, c["cand_id"]))
    want = [(r["row_id"], best[k][1], -best[k][0]) for r in items.collect() if (k := (r["title"], r["year"], r["director"])) in best]
    assert rows(df) == sorted(want, key=repr) and want


def test_library_match_counts_recurring_names(spark):
    """Names that recur n times on both sides meet once; copies of a candidate count once, under however many names."""
    n = 500
    items = spark.range(n).selectExpr("id AS row_id", "'The Very Long Title Indeed' AS title", "if(id % 2 = 0, 'tt1', null) AS imdb", "cast(null AS string) AS tmdb", "cast(if(id % 3 = 0, 1962, 1900) AS int) AS year")
    lib = spark.range(n).selectExpr("id AS lib_id", "if(id % 2 = 0, 'The Very Long Title Indeed', 'x The Very Long Title Indeed') AS name", "'tt1' AS imdb", "cast(null AS string) AS tmdb", "cast(1950 + if(id = 7, 12, id % 2) AS int) AS year")
    lib = lib.unionByName(lib.where("lib_id = 7").withColumn("name", F.lit("The Very Long Title Indeed y")))
    df = identity.library_match(items, lib)
    assert max(join_rows(df)) <= 2 * n
    # several by id settle on none; else the only one of the year, which is contained alone
    assert rows(df, "row_id", "basis", "candidate") == sorted([(i, 1, None) if i % 2 == 0 else (i, 4, 7) if i % 3 == 0 else (i, None, None) for i in range(n)], key=repr)


def test_resolve_counts_works_before_the_rows(spark):
    """Titles that recur n times on both sides never make n times n pairs."""
    n = 500
    works = spark.range(n).selectExpr("id", "'Dr No' AS title", "cast(null AS array<string>) AS aliases", "if(id = 3, 1963, 1962) AS year", "if(id = 4, 'Young', 'Hunt') AS director")
    r = spark.range(n).selectExpr("id AS row_id", "case when id % 5 = 0 then id when id % 5 = 1 then 9999 when id % 5 = 2 then 3 end AS work_ref", "if(id % 5 = 2, 'Other', 'Dr no') AS title", "if(id % 10 = 3, 1963, 1962) AS year", "if(id % 10 = 4, 'Young', 'Hunt') AS director")
    df = identity.resolve(r, works)
    assert max(join_rows(df)) <= n
    kinds = {0: "id", 1: "id_unknown", 2: "id_title_conflict", 3: "title_year", 4: "title_director", 5: "id", 6: "id_unknown", 7: "id_title_conflict", 8: "ambiguous", 9: "ambiguous"}
    found = {"id": lambda i: i, "title_year": lambda i: 3, "title_director": lambda i: 4}
    assert rows(df, "row_id", "reason", "work_id") == sorted([(i, kinds[i % 10], found.get(kinds[i % 10], lambda i: None)(i)) for i in range(n)], key=repr)


def test_enrich_joins_by_title_and_year(spark):
    """The year is a key of the join, and no condition on the pairs of a title; topics without a year meet the works of any year, and of none."""
    works = spark.createDataFrame([(1, "Dr No", 1962, "Young"), (2, "Dr No", 1963, None), (3, "Dr No", None, "Hunt"), (4, "Other", 1962, None)], "id int, title string, year int, director string")
    topics = spark.createDataFrame([(1, "[X] Dr.No (1962) 720p"), (2, "Dr No"), (3, "Dr No 1970"), (4, None)], "topic_id int, topic_title string")
    df = jobs.enrich(topics, works)
    assert rows(df, "topic_id", "title", "year", "director", "work_id") == sorted([(1, "Dr No", 1962, "Young", 1), (2, "Dr No", None, None, 2), (2, "Dr No", None, "Hunt", 3), (2, "Dr No", None, "Young", 1), (3, "Dr No", 1970, None, None), (4, None, None, None, None)], key=repr)
    joins = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "_ck" in line]
    assert joins and all("[_ck" in j and "_cy" in j.split("LeftOuter")[0] and "(isnull" not in j.split("LeftOuter")[1] for j in joins)


def test_dossiers_meet_works_by_kinds(spark):
    """Titles and links that recur n times on both sides never make n times n pairs; a work of several common links is one."""
    n = 500
    works = spark.range(n).selectExpr("id", "'Dr No' AS title", "if(id = 1, 1963, 1962) AS year", "if(id % 2 = 0, map('a', 'u', 'b', 'v'), map('a', concat('w', id))) AS links")
    ds = spark.range(n).selectExpr("id AS row_id", "'Dr  no' AS title", "if(id < 5, 1963, 1962) AS year", "if(id % 2 = 0, map('a', 'v', 'b', 'u', 'c', 'w3'), if(id = 9, map('a', 'w5'), map())) AS links")
    df = identity.dossier_ladder(ds, works)
    assert max(join_rows(df)) <= n
    want = [(i, 1, None, n // 2 + 1) if i % 2 == 0 else (i, 1, 5, 1) if i == 9 else (i, 2, 1, 1) if i < 5 else (i, 2, None, n - 1) for i in range(n)]
    assert rows(df, "row_id", "basis", "candidate", "n") == sorted(want, key=repr)


def test_family_claims_joins_what_a_page_can_use(spark):
    """Works that a user has seen elsewhere don't add to the reserves that are joined; a page that lacks primaries is filled for users who have seen nothing."""
    pools = spark.range(1_000).selectExpr("1 AS family", "0 AS page_pos", "cast(id AS int) AS work_id", "cast(id + 1 AS int) AS rank", "5 AS target", "true AS eligible")
    pools = pools.unionByName(spark.createDataFrame([(2, 0, 7, 1, 3, True), (2, 0, 8, 2, 3, True), (2, 0, 9, 4, 3, True)], pools.schema))
    follows = spark.range(40).selectExpr("cast(id AS int) AS user_id", "if(id = 0, 2, 1) AS family")
    seen = spark.range(1, 40).selectExpr("cast(id AS int) AS user_id", "explode(sequence(5000, 5300)) AS work_id").unionByName(spark.range(1, 40).selectExpr("cast(id AS int) AS user_id", "2 AS work_id"))
    df = personal.family_claims(follows, pools, seen)
    assert max(join_rows(df)) <= 40 * 16
    want = [(0, 2, 0, 7, 1), (0, 2, 0, 8, 2), (0, 2, 0, 9, 3)] + [(u, 1, 0, w, i + 1) for u in range(1, 40) for i, w in enumerate((0, 1, 3, 4, 5))]
    assert rows(df, "user_id", "family", "page_pos", "work_id", "slot") == sorted(want, key=repr)


def test_seen_state_shares_states(spark, tmp_path):
    """Users share states by the hash of their id, so that calls don't grow with users and keys; large ids and nulls stay what they are."""
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    schema = "user_id long, k string, ts timestamp, event_id long, action string"
    users = [None, 2**60 + 1, *range(100)]
    actions = [(u, k, at(10 * i + len(k or "")), i, a) for u in users for k in ("x", "yy", None) for i, a in enumerate(("a", "seen", "toggle", "seen"))]
    for n, part in enumerate((actions[::2], actions[1::2], [(7, "end", at(5000), 9, "seen")])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = jobs.seen_state(stream, "2 hours", buckets=8).writeStream.format("memory").queryName("shared_states").trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]) <= 8
    got = spark.table("shared_states")
    assert got.count() == len(actions) and {r["user_id"] for r in got.collect()} == set(users)
    last = got.groupBy("user_id", "k").agg(F.max_by(F.struct("status", "previous_status"), F.struct("ts_us", "event_id")).alias("s")).select("user_id", "k", "s.*")
    assert rows(last) == sorted([(u, k, "vu", "a") for u in users for k in ("x", "yy", None)], key=repr)
