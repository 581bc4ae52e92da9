"""Columns on hand-written values."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.functions import calendar, keys, parse, predicates


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize("f, text, want", [
    (keys.search_key, "L'Été à Œuvres!", "l'ete a œuvres!"), (keys.fresh_key, "Sœur Ümit", "s ur umit"), (keys.match_key, "Sœur Ümit", "soeur umit"), (keys.compact_key, "L' Été", "lete"),
    (keys.exact_key, "  Le   Grand Été ", "le grand été"), (keys.script_key, "Війна й мир: Ĳ", "віина и мир ĳ"), (keys.library_key, "Mr. & Mrs. Dr", "mister missus doctor"), (keys.slug, "L'Été 85", "l-ete-85"),
    (parse.iso_minutes, "PT1H45M", 105), (parse.iso_minutes, "PT0M", None), (parse.iso_minutes, "x", None), (parse.text_minutes, "1 h 45", 105), (parse.text_minutes, "2h", 120), (parse.text_minutes, "105 min (x)", 105),
    (parse.plausible_year, "1879", None), (parse.plausible_year, " 1994 ", 1994), (parse.url_host, "https://www.Example.org:80/x", "example.org"), (parse.work_form, "Série policière", "série"),
    (parse.clean_director, "Jane Doe [VOSTFR]", "Jane Doe"), (parse.channel_of_line, "20:50 · Arte", "Arte"), (parse.html_text, "<b>a</b>&amp;lt;&nbsp; x", "a &lt; x"), (parse.is_season_title, "Nom saison 2", True),
    (parse.provenance, "Sortie Blu-ray", "Blu-ray"), (parse.mark_score, "TTT", 3), (parse.mark_score, "?", None), (parse.priority_rank, "Bien", 2), (calendar.minutes, "24:00", None), (calendar.minutes, "05:59", 359),
    (predicates.specific_reason, "Indisponible", False), (predicates.specific_reason, "aucune note trouvée sur les trois sites", True), (predicates.placeholder, "Lorem ipsum", False), (predicates.placeholder, "<p>AU-DESSUS du seuil Éditorial de la semaine", True), (parse.html_text, "&eacute;&#x41;&#0;&foo;&amp;#65;", "éA\ufffd&foo;&#65;"), (predicates.source_ref_error, "x", "source_ref"),
])
def test_values(spark, f, text, want):
    assert value(spark, f(F.lit(text))) == want


def test_calendar(spark):
    d = lambda s: F.lit(s).cast("date")
    for k in range(0, 1500, 13):
        day = datetime.date(2024, 1, 6) + datetime.timedelta(weeks=k // 7)
        assert value(spark, calendar.saturday_of_week(calendar.week_of_saturday(d(str(day))))) == day
    assert value(spark, calendar.week_of_saturday(d("2026-12-26"))) == "2026-S53"
    assert value(spark, calendar.target_saturday(d("2024-01-06"))) == datetime.date(2024, 1, 6)
    assert value(spark, calendar.target_saturday(d("2024-01-07"))) == datetime.date(2024, 1, 13)
    assert value(spark, calendar.range_label(d("2024-12-28"))) == "du 28 décembre 2024 au 3 janvier 2025"
    assert value(spark, calendar.range_label(d("2024-02-03"))) == "du 3 au 9 février 2024"
    assert value(spark, calendar.civil_date(d("2024-02-03"), F.lit(100))) == datetime.date(2024, 2, 4)
    assert value(spark, calendar.valid_date(F.lit("2024-02-30"))) is None


def test_rating_entries(spark):
    m = F.create_map(F.lit("imdb"), F.lit("7.1"), F.lit("IMDb"), F.lit("7,2"), F.lit("press"), F.lit("3/5"))
    got = value(spark, parse.rating_entries(m, {"imdb": "IMDb"}))
    assert [(r["label"], r["text"]) for r in got] == [("IMDb", "7,2/10"), ("press", "3/5")]
    assert str(value(spark, parse.rating(F.lit("7,9/10 (134,8 k)")))) == "7.9" and value(spark, parse.rating(F.lit("12"))) is None


def test_french_times(spark):
    now = F.lit("2024-01-05 12:00:00").cast("timestamp")
    at = lambda t: str(value(spark, parse.french_activity_time(F.lit(t), now).cast("string")))
    assert at("Aujourd'hui 09:30") == "2024-01-05 09:30:00" and at("Hier 23:10, le 2 janvier 08:00") == "2024-01-04 23:10:00"
    assert at("28 décembre 10:00") == "2023-12-28 10:00:00" and at("rien") == "None"


def test_release_titles(spark):
    r = value(spark, parse.release_title(F.lit("[X] Le.Grand.Bleu (1988) 1080p.x264")))
    assert (r["title"], r["year"], r["director"]) == ("Le Grand Bleu", 1988, None)
    told = lambda t: tuple(value(spark, parse.release_title(F.lit(t))))
    assert told("Titre - 1962 - Terence Young") == ("Titre", 1962, "Terence Young") and told("[A] [B] Titre (1962) Terence Young VOSTFR 1080p x264") == ("Titre", 1962, "Terence Young")
    assert told("1984 - 1984 - Michael Radford") == ("1984 - 1984 - Michael Radford", 1984, "1984 - Michael Radford") and told("Sans année HDRip") == ("Sans année", None, None)
    assert told("Titre 2001 &amp; x264 multi") == ("Titre", 2001, None) and told("2012") == ("2012", 2012, None)
    assert value(spark, parse.title_variants(F.lit("A (B) - C"))) == ["A (B) - C", "B", "A - C", "A (B)"]
    assert value(spark, parse.image_kind(F.unhex(F.lit("FFD8FFE000104A464946")))) == "jpeg"
    assert value(spark, parse.image_kind(F.unhex(F.lit("524946460000000057454250")))) == "webp"


def test_predicates(spark):
    links = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    ok = lambda *a: value(spark, predicates.strong_identity(*a))
    alloc = links(allocine="https://www.allocine.fr/film/fichefilm_gen_cfilm=1.html")
    assert ok(links(imdb="https://www.imdb.com/title/tt0000001/")) and ok(alloc) and not ok(alloc, "card")
    assert not ok(links(official="https://www.youtube.com/x")) and ok(links(official="https://studio.example.org/x"))
    ts = lambda s: F.lit(s).cast("timestamp")
    state = lambda *a: value(spark, predicates.retry_state(*map(ts, a)))
    assert state("2024-01-01", "2024-01-03", "2024-01-09", "2024-01-02") == "waiting" and state("2024-01-01", "2024-01-03", "2024-01-09", "2024-01-04") == "reopened"
    assert state("2024-01-01", "2024-01-03", "2024-01-09", "2024-01-10") == "expired" and state("2024-01-05", "2024-01-03", None, "2024-01-10") == "invalid"
    assert value(spark, F.array_join(predicates.banned_urls(F.lit('a https://x.org/search?q=1 "https://x.org/ok"')), ",")) == "https://x.org/search?q=1"
