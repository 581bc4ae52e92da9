"""Filters and audit predicates (F01 to F26), as boolean or error-code columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.keys import search_key

#: Hosts that never prove an identity, search-result URLs, generic copy that is never published and vague reasons.
DENIED_HOSTS = ("google.com", "bing.com", "duckduckgo.com", "youtube.com", "facebook.com")
SEARCH_URLS = r"(?i)(google\.[a-z.]+/search|bing\.com/search|duckduckgo\.com/\?q=|/recherche[/?]|/search[/?]|[?&](q|query|search)=)"
BANNED_COPY = (
    r"Rubrique conservée\s*;\s*publication prudente",
    r"Au-dessus du seuil éditorial de la semaine",
    r"Retenu après inventaire et filtre éditorial",
    r"Retenu pour son intérêt cinématographique,\s*sa singularité ou sa valeur patrimoniale",
)
VAGUE = r"(?i)^(non disponible|indisponible|n/?a|aucune?|inconnue?|pas de note)\.?$"


def catalogue_search(fields: list[Column], q: str | None = None, occurrences: Column | None = None, week: str | None = None, kind: tuple[Column, str] | None = None, director: tuple[Column, str] | None = None, country: tuple[Column, str] | None = None) -> Column:
    """substring of the joined fields, and week, kind, director (equal) and country (substring) filters."""
    out = F.lit(True)
    if q:
        out = out & F.contains(search_key(F.concat_ws(" ", *fields)), search_key(F.lit(q)))
    if week and occurrences is not None:
        out = out & F.exists(occurrences, lambda o: o["week"] == week)
    for pair in (kind, director):
        if pair:
            out = out & (pair[0] == pair[1])
    return out & F.contains(country[0], F.lit(country[1])) if country else out


def calendar_filter(kind: Column, date: Column, want_kind: str | None, month: str | None) -> Column:
    """release kind and month."""
    return (F.lit(True) if want_kind is None else kind == want_kind) & (F.lit(True) if month is None else F.date_format(date, "yyyy-MM") == month)


def watch_filter(status: Column, want: str = "a-recuperer") -> Column:
    """watch-list status; an absent one is the default."""
    return F.coalesce(status, F.lit("a-recuperer")) == want


def in_week(date: Column, first: Column, last: Column) -> Column:
    """whether a row is inside the week; outside rows are returned apart by the caller."""
    return F.coalesce(date.between(first, last), F.lit(False))


def recent(at: Column, now: Column, hours: Column) -> Column:
    """from ``hours`` (1 to 168) ago to ten minutes ahead."""
    h = F.least(F.greatest(hours, F.lit(1)), F.lit(168))
    return (F.unix_timestamp(at) >= F.unix_timestamp(now) - h * 3600) & (F.unix_timestamp(at) <= F.unix_timestamp(now) + 600)


def strong_identity(links: Column, profile: str = "reserve") -> Column:
    """an exact id link, or an official host that isn't denied. AlloCiné counts in the ``reserve`` profile only."""
    link = lambda k: F.coalesce(F.try_element_at(links, F.lit(k)), F.lit(""))
    out = link("imdb").rlike(r"/title/tt\d+") | link("tmdb").rlike(r"/(movie|tv)/\d+") | link("sc").rlike(r"senscritique\.com/[^/]+/[^/]+/\d+")
    if profile == "reserve":
        out = out | link("allocine").rlike(r"_gen_c(film|serie)=\d+")
    denied = "|".join(h.replace(".", r"\.") for h in DENIED_HOSTS)
    return out | (link("official").rlike("^https?://") & ~link("official").rlike(rf"(?i)^https?://([^/]*\.)?({denied})(/|$)"))


def banned_urls(text: Column) -> Column:
    """the search-result URLs in any text."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(https?://[^\s\"'<>\\]+)"), 1), lambda u: u.rlike(SEARCH_URLS))


def link_shape_error(kind: Column, url: Column) -> Column:
    """an error code for IMDb and SensCritique links that are not exact pages."""
    return F.when((kind == "imdb") & ~url.rlike(r"^https://www\.imdb\.com/title/tt\d{7,}/?$"), "imdb_shape").when((kind == "sc") & ~url.rlike(r"^https://www\.senscritique\.com/(film|serie)/[^/]+/\d+$"), "sc_shape")


def specific_reason(reason: Column) -> Column:
    """a reason of 24 characters or more that isn't vague."""
    return F.coalesce((F.length(F.trim(reason)) >= 24) & ~F.trim(reason).rlike(VAGUE), F.lit(False))


def reserve_eligible(r: dict[str, Column], week: Column, strict_from: str) -> Column:
    """image, director, year, identity, and a rating or a specific reason; from a given week also country, duration, genre and texts of 45 characters."""
    there = lambda c: F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))
    base = there(r["image"]) & there(r["director"]) & there(r["year"]) & r["identity"] & ((F.coalesce(F.size(r["ratings"]), F.lit(0)) > 0) | specific_reason(r["reason"]))
    more = there(r["country"]) & there(r["duration"]) & there(r["genre"])
    more = more & F.coalesce(F.length(r["summary"]) >= 45, F.lit(False)) & F.coalesce(F.length(r["why"]) >= 45, F.lit(False))
    return base & ((week < strict_from) | more)


def evidence_error(url: Column, digest: Column, page: Column, box: Column, authority: Column) -> Column:
    """null if a row has an http(s) URL, or the provided digest with a page and a box of four numbers; else what is wrong."""
    return (
        F.when(F.coalesce(url.rlike("^https?://"), F.lit(False)), F.lit(None).cast("string")).when(digest.isNull(), "no_source")
        .when(~digest.eqNullSafe(authority), "digest").when(F.coalesce(page, F.lit(0)) < 1, "page").when(F.coalesce(F.size(box), F.lit(0)) != 4, "box")
    )


def source_ref_error(ref: Column) -> Column:
    """a reference is a URL or ``sha256:<64 hex>#page=N``."""
    return F.when(~F.coalesce(ref.rlike(r"^(https?://\S+|sha256:[0-9a-f]{64}#page=\d+)$"), F.lit(False)), "source_ref")


def evidence_errors(r: dict[str, Column], fields: list[str]) -> Column:
    """the error codes of a compact evidence record."""
    bad = lambda cond, code: F.when(~F.coalesce(cond, F.lit(False)), code)
    return F.array_compact(F.array(
        bad(r["url"].rlike(r"^(https?://|sha256:)"), "url"), bad(r["checked_at"].isNotNull(), "checked_at"), bad(r["field"].isin(*fields), "field"),
        bad(r["result"].isin("found", "not_found", "unclear"), "result"), F.when((r["result"] == "found") & (F.coalesce(F.trim(r["value"]), F.lit("")) == ""), "value"),
        F.when(r["stability"].isNotNull() & ~r["stability"].isin("stable", "dynamic"), "stability"),
    ))


def contract_errors(box: Column, width: Column, height: Column, start: Column, allowed: Column, names: Column) -> Column:
    """box inside the page, a clock time, and no field beyond the allowed ones."""
    inside = (F.size(box) == 4) & (F.get(box, 0) >= 0) & (F.get(box, 1) >= 0) & (F.get(box, 2) <= width) & (F.get(box, 3) <= height) & (F.get(box, 0) < F.get(box, 2)) & (F.get(box, 1) < F.get(box, 3))
    return F.array_compact(F.array(
        F.when(~F.coalesce(inside, F.lit(False)), "box"), F.when(~F.coalesce(start.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.lit(False)), "start"),
        F.when(F.size(F.array_except(names, allowed)) > 0, "fields"),
    ))


def scope_matches(constraint: Column, value: Column) -> Column:
    """a null constraint matches all; a list means membership."""
    return constraint.isNull() | F.array_contains(constraint, value)


def pause_covers(p: dict[str, Column], obs: dict[str, Column]) -> Column:
    """F16: a pause covers an observation if its date, channel, version and offer scopes all do."""
    out = F.lit(True)
    for k in ("date", "channel", "version", "offer"):
        out = out & (p[k].isNull() | p[k].eqNullSafe(obs[k]))
    return out


def retry_state(checked: Column, retry_after: Column, expires: Column, now: Column) -> Column:
    """invalid, waiting, reopened or expired at an instant."""
    bad = retry_after.isNull() | (checked.isNotNull() & (retry_after < checked)) | (expires.isNotNull() & (expires < retry_after))
    return F.when(bad, "invalid").when(expires.isNotNull() & (expires <= now), "expired").when(retry_after <= now, "reopened").otherwise("waiting")


def placeholder(text: Column) -> Column:
    """generic copy that is banned from publication, in any case."""
    return F.coalesce(text.rlike("(?iu)" + "|".join(BANNED_COPY)), F.lit(False))


def shortage_errors(reason: Column, sources: Column, count: Column, actual: Column) -> Column:
    """a structured shortage has a reason of 24 characters, two sources and the actual count."""
    return F.array_compact(F.array(
        F.when(F.coalesce(F.length(F.trim(reason)), F.lit(0)) < 24, "reason"), F.when(F.coalesce(F.size(F.array_distinct(sources)), F.lit(0)) < 2, "sources"), F.when(~count.eqNullSafe(actual), "count"),
    ))


def poster_errors(work: Column, path: Column, declared: Column, content: Column, most_bytes: int = 400_000) -> Column:
    """the path carries the id, the digest is that of the bytes, and the weight is within the limit."""
    return F.array_compact(F.array(
        F.when(F.regexp_extract(path, r"([^/]+)\.[a-z]+$", 1) != work, "path"), F.when(~F.sha2(content, 256).eqNullSafe(declared), "digest"), F.when(F.octet_length(content) > most_bytes, "weight"),
    ))


def exception_errors(context: Column, reason: Column, contexts: list[str]) -> Column:
    """a freshness exception has an allowed context and a reason of 20 characters."""
    return F.array_compact(F.array(F.when(~F.coalesce(context.isin(*contexts), F.lit(False)), "context"), F.when(F.coalesce(F.length(F.trim(reason)), F.lit(0)) < 20, "reason")))


def admission_error(title: Column, date: Column, start: Column, channel: Column, first: Column, last: Column) -> Column:
    """why an observation is refused; null if it is admitted."""
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return F.when(empty(title), "title").when(date.isNull(), "date").when(~F.coalesce(start.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.lit(False)), "start").when(empty(channel), "channel").when(~in_week(date, first, last), "outside_week")


def missing_facts(fields: dict[str, Column]) -> Column:
    """names of the facts that are absent."""
    return F.array_compact(F.array(*[F.when(v.isNull() | (F.trim(v.cast("string")) == ""), F.lit(k)) for k, v in fields.items()]))
