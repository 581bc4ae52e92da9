"""Parsers and projections of one row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.keys import match_key, unaccent

#: The named entities that pages use.
ENTITIES = {
    "amp": "&", "AMP": "&", "lt": "<", "LT": "<", "gt": ">", "GT": ">", "quot": '"', "QUOT": '"', "apos": "'", "nbsp": "\u00a0", "laquo": "«", "raquo": "»", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "ndash": "–", "mdash": "—", "hellip": "…", "middot": "·", "eacute": "é", "Eacute": "É", "egrave": "è", "Egrave": "È", "ecirc": "ê", "Ecirc": "Ê",
    "agrave": "à", "Agrave": "À", "acirc": "â", "Acirc": "Â", "ocirc": "ô", "Ocirc": "Ô", "icirc": "î", "Icirc": "Î", "iuml": "ï", "Iuml": "Ï", "ugrave": "ù", "Ugrave": "Ù",
    "ucirc": "û", "Ucirc": "Û", "ccedil": "ç", "Ccedil": "Ç", "ouml": "ö", "Ouml": "Ö", "auml": "ä", "Auml": "Ä", "uuml": "ü", "Uuml": "Ü",
}
ENTITY = r"(?i)&(#(?:x[0-9a-f]+|[0-9]+)|[a-z][a-z0-9]+);"
#: White space as browsers' scripts see it.
SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

#: Provider, pattern of a canonical URL, and the id as its groups make it. Movies and series are numbered separately, so their kind belongs to the id.
IDENTITY_PATTERNS = (
    ("senscritique", r"^https://www\.senscritique\.com/(film|serie)/[^/?#]+/(\d+)/?$", "$1/$2"),
    ("imdb", r"^https://www\.imdb\.com/(?:fr/)?title/(tt\d+)/?$", "$1"),
    ("tmdb", r"^https://www\.themoviedb\.org/(movie|tv)/(\d+)(?:-[^/?#]*)?/?$", "$1/$2"),
    ("arte", r"^https://(?:www\.arte\.tv/[a-z]{2}/videos|api(?:-cdn)?\.arte\.tv/api/player/v2/config/[a-z]{2})/(\d{6}-\d{3}-[A-Z])(?:/[^?#]*)?$", "$1"),
    ("francetvpro", r"^https://www\.francetvpro\.fr/contenu-de-presse/(\d+)/?$", "$1"),
    ("tv5monde", r"^(https://www\.tv5mondeplus\.com/api/psi/programs-grid\?(?=[^#]*\bchannel=\d+)(?=[^#]*\bday=\d{4}-\d{2}-\d{2})[^#]+)#program=(\d+)$", "$1#$2"),
    ("wikidata", r"^https://www\.wikidata\.org/wiki/(Q\d+)/?$", "$1"),
    ("wikipedia", r"^https://(fr|en)\.wikipedia\.org/wiki/([^/?#]+)$", "$1:$2"),
)
#: Grid marks from low to high, and the order in which suggestions are ranked.
MARKS = ("Hélas", "T", "TT", "TTT", "TTTT")
PRIORITY_ORDER = ("Bravo", "Très bien", "Bien")


def decode_entities(c: Column) -> Column:
    """Named and numeric entities, each decoded once: what comes of one isn't read again. Unknown names stay; numbers that are no character become U+FFFD."""
    names = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def decoded(e: Column) -> Column:
        name = F.substring(e, F.lit(2), F.length(e) - 2)
        hexed = F.lower(F.substring(name, 2, 1)) == "x"
        digits = F.regexp_replace(F.when(hexed, F.substring(name, 3, 1 << 20)).otherwise(F.substring(name, 2, 1 << 20)), "^0+", "")
        # more than ten digits are no character in either base
        code = F.when(F.length(digits).between(1, 10), F.when(hexed, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long"))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(F.startswith(name, F.lit("#")), F.when(valid, char).otherwise("\ufffd")).otherwise(F.coalesce(F.try_element_at(names, name), e))

    found, between = F.regexp_extract_all(c, F.lit(ENTITY), 0), F.split(c, ENTITY)
    # lambdas read their own elements alone: anything else in them is computed for each
    after = F.zip_with(found, F.slice(between, 2, 1 << 30), lambda e, text: F.concat(decoded(e), text))
    return F.when(F.contains(c, F.lit("&")), F.concat(F.get(between, F.lit(0)), F.array_join(after, ""))).otherwise(c)


def html_text(c: Column) -> Column:
    """Tags are spaces, entities are decoded once, white space collapses."""
    plain = F.regexp_replace(decode_entities(F.regexp_replace(c, "<[^>]+>", " ")), f"{SPACE}+", " ")
    return F.trim(plain)


def _int(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("int")


def iso_minutes(c: Column) -> Column:
    """``PT1H45M`` in minutes; null for other texts and for an empty duration."""
    h, m = _int(c, r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$", 1), _int(c, r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$", 2)
    total = F.coalesce(h, F.lit(0)) * 60 + F.coalesce(m, F.lit(0))
    return F.when(h.isNotNull() | m.isNotNull(), F.nullif(total, F.lit(0)))


def text_minutes(c: Column) -> Column:
    """``1 h 45``, ``2h``, ``105 min (…)`` in minutes."""
    h = _int(c, r"(?i)(\d+)\s*h", 1)
    after = F.coalesce(_int(c, r"(?i)\d+\s*h\s*(\d{1,2})", 1), F.lit(0))
    return F.coalesce(h * 60 + after, _int(c, r"(?i)(\d+)\s*min", 1))


def plausible_year(c: Column) -> Column:
    """A year from 1880 to 2100."""
    y = F.trim(c.cast("string")).try_cast("int")
    return F.when(y.between(1880, 2100), y)


def expected_year(year: Column, work: Column) -> Column:
    """The plausible year, else that at the end of the id."""
    return F.coalesce(plausible_year(year), plausible_year(F.regexp_extract(work, r"-(\d{4})$", 1)))


def split_names(c: Column, pattern: str = r"[/,;&]|\s+et\s+") -> Column:
    """The names in a list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != "")


def split_directors(c: Column) -> Column:
    return split_names(c, "[/&]")


def split_countries(c: Column) -> Column:
    return split_names(c, "/")


def rating(c: Column) -> Column:
    """A rating from 0 to 10 with one decimal, of ``7,6``, ``7.6`` or ``7,9/10 (134 k)``."""
    text = F.regexp_extract(c, r"^\s*(\d+(?:[.,]\d+)?)", 1)
    value = F.replace(F.nullif(text, F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(6,3)")
    return F.when(value.between(0, 10), F.round(value, 1).cast("decimal(3,1)"))


def rating_label(value: Column) -> Column:
    """One decimal with a comma."""
    return F.replace(value.cast("decimal(3,1)").cast("string"), F.lit("."), F.lit(","))


def rating_entries(ratings: Column, aliases: dict[str, str]) -> Column:
    """Labelled entries of a ratings map: publisher alias, ``/10`` only for bare numbers of IMDb and SC, labels distinct (the first in key order stays)."""
    names = F.create_map(*[F.lit(x) for kv in (aliases or {"": ""}).items() for x in kv])

    def entry(e: Column) -> Column:
        label = F.coalesce(F.try_element_at(names, F.lower(e["key"])), e["key"])
        bare = e["value"].rlike(r"^\d+([.,]\d+)?$") & label.isin("IMDb", "SC")
        return F.struct(label.alias("label"), F.concat(e["value"], F.when(bare, "/10").otherwise("")).alias("text"))

    listed = F.transform(F.array_sort(F.map_entries(ratings)), entry)
    return F.filter(listed, lambda e, i: F.array_position(F.transform(listed, lambda x: x["label"]), e["label"]) == i + 1)


def url_host(c: Column) -> Column:
    """P20: the host of a URL in lower case without ``www.``."""
    host = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit(""))


def external_id(url: Column) -> Column:
    """``struct(provider, ext_id)`` of a canonical URL, else null."""
    out = F.lit(None).cast("struct<provider: string, ext_id: string>")
    for provider, pattern, made in reversed(IDENTITY_PATTERNS):
        out = F.when(url.rlike(pattern), F.struct(F.lit(provider).alias("provider"), F.regexp_replace(url, pattern, made).alias("ext_id"))).otherwise(out)
    return out


#: Fixed values of P24: vocabulary of releases, notes of language and edition, and what a director never is.
RELEASE_TAIL = (
    r"2160p|1080p|720p|576p|480p|4k|uhd|blu[ .-]?ray|bdrip|bdremux|remux|web[ .-]?dl|webrip|hdrip|dvdrip|x26[45]|h[ .-]?26[45]|hevc|av1|multi|truefrench|french|vostfr|subfrench|"
    r"dts(?:[ .-]?hd)?|aac|ac3|eac3|atmos|hdr10\+?|hdr|dolby[ .-]?vision|\bdv\b|proper|repack"
)
LANGUAGE_NOTES = r"vostfr|vo(?:\s+ou\s+vf)?|vf|multi|truefrench|french|subfrench"
NO_DIRECTOR = r"1080p|720p|2160p|4k|bluray|blu-ray|web[- .]?dl|remux|x26[45]|hevc|hdr|vostfr|french|multi"


def _stripped(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, rf"^[{chars}]+|[{chars}]+$", "")


def release_title(raw: Column) -> Column:
    """``struct(title, year, director)`` of a release title such as ``[tag] Title - 1962 - Director VOSTFR 1080p``.

    Leading tags go and the technical tail is cut. What stands before the first year from
    1900 to 2099 is the title; what stands after it, without notes of language, the
    director, if it has 3 to 90 characters and no word of the trade. Without a year there
    is no director. Parentheses around the year go with it.
    """
    dated = r"^(.*?)\b(19\d{2}|20\d{2})\b(.*)$"

    def parts(text: Column) -> Column:
        return F.struct(text.alias("text"), *[F.regexp_extract(text, dated, g).alias(f"g{g}") for g in (1, 2, 3)])

    def cleaned(p: Column) -> Column:
        after = F.regexp_replace(p["g3"], "^[ .–—:;)-]+|[ .–—:;-]+$", "")
        after = F.regexp_replace(after, rf"(?i)\s*\((?:{LANGUAGE_NOTES}|téléfilm|telefilm)[^)]*\)\s*$", "")
        after = _stripped(F.regexp_replace(after, rf"(?i)\s+(?:{LANGUAGE_NOTES})\b.*$", ""), " .–—:;-")
        return F.struct(p["text"].alias("text"), F.nullif(p["g2"], F.lit("")).try_cast("int").alias("year"), _stripped(p["g1"], " .–—(-").alias("before"), after.alias("after"))

    def told(c: Column) -> Column:
        title = F.when(F.length(c["before"]) >= 2, c["before"]).otherwise(c["text"])
        title = _stripped(F.regexp_replace(F.regexp_replace(title, r"[.]+", " "), r"\s{2,}", " "), " .–—-")
        director = F.when(F.length(c["after"]).between(3, 90) & ~c["after"].rlike(rf"(?i)\b(?:{NO_DIRECTOR})\b"), c["after"])
        return F.struct(title.alias("title"), c["year"].alias("year"), director.alias("director"))

    text = F.trim(F.replace(F.regexp_replace(decode_entities(raw), r"^\s*(?:\[[^\]]+\]\s*)+", ""), F.lit("_"), F.lit(" ")))
    # each step is bound to a variable of a lambda, so that it is computed once however often the next ones read it
    steps = F.array(F.regexp_replace(text, rf"(?i)\s+(?:{RELEASE_TAIL}).*$", ""))
    for step in (parts, cleaned, told):
        steps = F.transform(steps, step)
    r = F.transform(steps, lambda t: F.struct(F.when(t["title"] != "", t["title"]).otherwise(F.trim(raw)).alias("title"), t["year"].alias("year"), t["director"].alias("director")))
    return F.get(r, F.lit(0))


def clean_director(c: Column) -> Column:
    """Language tags and brackets removed from a director guess."""
    out = F.regexp_replace(c, r"(?i)[\[(]?\b(vostfr|vost|vf|vff|vo|multi|truefrench|french|english)\b[\])]?", " ")
    return F.nullif(F.trim(F.regexp_replace(out, r"[\s\-–,]+", " ")), F.lit(""))


def title_variants(title: Column, aliases: Column | None = None, most: int = 8) -> Column:
    """The title, the text in and outside its parentheses, what stands before ' - ', and aliases; distinct, at most ``most``."""
    inside = F.trim(F.regexp_extract(title, r"\(([^)]+)\)", 1))
    outside = F.trim(F.regexp_replace(F.regexp_replace(title, r"\([^)]*\)", " "), r"\s+", " "))
    before = F.trim(F.element_at(F.split(title, " - "), 1))
    own = F.array(F.trim(title), inside, outside, before)
    every = F.concat(own, F.coalesce(aliases, F.array().cast("array<string>"))) if aliases is not None else own
    return F.slice(F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != ""))), 1, most)


def provenance(context: Column) -> Column:
    """Where a watch-list entry comes from."""
    t = unaccent(F.lower(F.coalesce(context, F.lit(""))))
    out = F.when(t.rlike("blu-?ray|dvd"), "Blu-ray").when(t.contains("radar"), "Radar").when(t.contains("replay"), "Replay")
    return out.when(t.rlike("stream|vod|netflix|plateforme"), "Streaming").otherwise("TV")


def record_id(*values: Column) -> Column:
    """First 20 hex digits of SHA-256 of the values as a JSON list."""
    text = F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(F.to_json(F.array(v.cast("string"))), F.lit("[null]")) for v in values]), F.lit("]"))
    return F.substring(F.sha2(text, 256), 1, 20)


def version_key(*fields: Column) -> Column:
    """A fingerprint of optional fields; a null counts as a value."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), f.cast("string")), F.lit("-")) for f in fields])


def mark_score(mark: Column) -> Column:
    """0 for the lowest grid mark to 4, null for unknown ones."""
    return F.nullif(F.array_position(F.array(*map(F.lit, MARKS)), mark), F.lit(0)).cast("int") - 1


def priority_rank(label: Column) -> Column:
    """Place in the order of priority, after all for other labels."""
    at = F.array_position(F.array(*map(F.lit, PRIORITY_ORDER)), label).cast("int")
    return F.when(at > 0, at - 1).otherwise(len(PRIORITY_ORDER))


def section_matches(page: Column, base: str) -> Column:
    """Whether a page belongs to a family: its id, or its id with a number."""
    return page.rlike(rf"^{re.escape(base)}(-\d+)?$")


def work_form(genre: Column) -> Column:
    """Documentary, series or film."""
    g = unaccent(F.lower(F.coalesce(genre, F.lit(""))))
    return F.when(g.contains("documentaire"), "documentaire").when(g.rlike("serie|feuilleton"), "série").otherwise("film")


def is_season_title(title: Column) -> Column:
    """Whether a title names a season."""
    return F.lower(title).rlike(r"\bsaison\s+\d+|\bseason\s+\d+|\bs\d{1,2}\b")


def image_order(image: Column, fallbacks: Column, extra: Column) -> Column:
    """Distinct image candidates: primary, fallbacks, extras."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(F.array(image), F.coalesce(fallbacks, none), F.coalesce(extra, none)), lambda x: x.isNotNull() & (x != "")))


def image_kind(content: Column) -> Column:
    """The image type told by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 12))
    text = F.lower(F.decode(F.substring(content, 1, 256), "ISO-8859-1"))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("47494638"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").when(F.substring(head, 9, 16) == "6674797061766966", "avif").when(text.contains("<svg"), "svg")
    )


def ratings_note(labels: Column) -> Column:
    """The ratings of a list in words."""
    return F.when(F.size(labels) > 0, F.array_join(labels, " et "))


def meta_line(*fields: Column) -> Column:
    """Fields joined by middle dots, nulls and empty ones skipped."""
    return F.concat_ws(" · ", *[F.nullif(f.cast("string"), F.lit("")) for f in fields])


def evidence_urls(*lists: Column, most: int = 6) -> Column:
    """Distinct http(s) URLs of several lists in order, at most ``most``."""
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.filter(F.concat(*[F.coalesce(x, none) for x in lists]), lambda u: u.rlike("^https?://"))), 1, most)


def channel_of_line(line: Column) -> Column:
    """The channel in ``time · channel``; null without a middle dot."""
    return F.when(line.contains("·"), F.trim(F.element_at(F.split(line, "·"), 2)))


def meta_fields(line: Column) -> Column:
    """A ``key : value · key : value`` line as a map with trimmed keys and values."""
    parts = F.filter(F.split(line, "·"), lambda x: x.contains(":"))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v"))
    return F.map_from_entries(F.transform(parts, pair))


def canonical_channel(name: Column) -> Column:
    """The key under which channel aliases are joined."""
    return match_key(name)


def french_activity_time(text: Column, now: Column) -> Column:
    """P25: the newest time a French activity text names: ``Aujourd'hui 14:05``, ``Hier 09:00``, or day and month (a date beyond now + 2 days is of last year)."""
    t = unaccent(F.lower(text))
    clock = lambda x: F.coalesce(F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), F.nullif(F.regexp_extract(x, r"(\d{1,2}:\d{2})", 1), F.lit(""))), F.lit("yyyy-MM-dd H:mm")), F.lit("1970-01-01 00:00:00").cast("timestamp"))
    secs = lambda x: F.unix_timestamp(clock(x)) - F.unix_timestamp(F.lit("1970-01-01 00:00:00").cast("timestamp"))
    day = F.unix_timestamp(F.date_trunc("day", now))
    names = [unaccent_text(m) for m in ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")]

    def at(x: Column) -> Column:
        month = F.array_position(F.array(*map(F.lit, names)), F.regexp_extract(x, r"\d{1,2} (" + "|".join(names) + ")", 1)).cast("int")
        d = _int(x, r"(\d{1,2}) (?:" + "|".join(names) + ")", 1)
        year = F.coalesce(_int(x, r"(?:" + "|".join(names) + r") (\d{4})", 1), F.year(now))
        stamp = F.unix_timestamp(F.make_date(year, F.when(month > 0, month), F.when(month > 0, d)).cast("timestamp")) + secs(x)
        past = F.unix_timestamp(F.add_months(F.timestamp_seconds(stamp).cast("date"), -12).cast("timestamp")) + secs(x)
        given = F.when((stamp > F.unix_timestamp(now) + 2 * 86400) & ~x.rlike(r"\d{4}"), past).otherwise(stamp)
        return F.when(x.contains("aujourd"), day + secs(x)).when(x.contains("hier"), day - 86400 + secs(x)).otherwise(given)

    found = F.regexp_extract_all(t, F.lit(r"((?:aujourd.?hui|hier|\d{1,2} (?:" + "|".join(names) + r")(?: \d{4})?)[^\d]{0,6}(?:\d{1,2}:\d{2})?)"), 1)
    return F.timestamp_seconds(F.array_max(F.transform(found, at)))


def unaccent_text(s: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def evidence_view(r: dict[str, Column]) -> Column:
    """One shape for compact and legacy evidence: ``struct(url, field, result, value, stability)``.

    Compact records have ``url`` and ``result``; legacy ones ``source_urls`` and
    ``status``. Stability defaults by field: schedules and offers change.
    """
    status = F.when(r["status"].isin("confirmed", "found"), "found").when(r["status"].isin("missing", "not_found"), "not_found").when(r["status"].isNotNull(), "unclear")
    field = F.coalesce(r["field"], F.element_at(F.filter(r["fields"], lambda x: x.isNotNull()), 1) if "fields" in r else F.lit(None).cast("string"))
    stability = F.coalesce(r["stability"], F.when(field.isin("broadcast", "offer", "availability"), "dynamic").otherwise("stable"))
    return F.struct(F.coalesce(r["url"], F.get(r["source_urls"], 0)).alias("url"), field.alias("field"), F.coalesce(r["result"], status).alias("result"), r["value"].alias("value"), stability.alias("stability"))


def section_facts(spec: Column, dossier: Column, required: list[str]) -> Column:
    """Facts of a card: each required field from the card, else from the dossier, and the names that neither has."""
    got = {f: F.coalesce(spec[f], dossier[f]) for f in required}
    missing = F.array_compact(F.array(*[F.when(v.isNull() | (v == ""), F.lit(f)) for f, v in got.items()]))
    return F.struct(*[v.alias(f) for f, v in got.items()], missing.alias("missing"))
