"""Rows out of captured pages (S09 to S12, S14 to S16), with built-in functions over a capture table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.calendar import FRENCH_MONTHS, minutes, paris, weekday_name
from gridloom.functions.parse import decode_entities, html_text


#: Fixed value: what a page says that is a challenge, or out of order, and no schedule.
UNAVAILABLE = r"(?i)verify you are human|site unavailable|just a moment|access denied"
CHALLENGE = r"(?i)<form\b[^>]*(?:challenge-form|cf-challenge)"


@dataclass(frozen=True)
class GuideLayout:
    """How a guide lists its programmes. Patterns give an item, or a field of one, as their first group."""

    #: Where an item begins, and a pattern that occurs once an item: fewer or more of it than of whole items is a truncated page.
    opening: str
    counted: str
    #: Closing tag that a whole item has, if items don't just end where the next begins.
    closing: str | None
    time: str
    title: str
    subtitle: str
    link: str
    link_needed: bool
    #: The first time of a page is no earlier; a step back goes to before ``morning`` from ``evening`` or later.
    first: int
    morning: int
    evening: int
    #: Whether case counts in the canonical URL, and whether the page's title names its date.
    exact_url: bool
    dated_title: bool
    url_prefix: str = ""


def _tag(name: str, mark: str) -> str:
    return rf"(?is)<{name}\b[^>]*{mark}[^>]*>(.*?)</{name}>"


#: Fixed values of S09: the marks of the two guides' pages.
BROADCASTER_GUIDE = GuideLayout(
    opening=r"(?i)<li\b[^>]*data-testid=[\"']tsguide-itm[\"'][^>]*>", counted=r"(?i)<li\b[^>]*data-testid=[\"']tsguide-itm[\"'][^>]*>", closing="</li>", time=r"<span\b[^>]*>(\d{2}:\d{2})</span>",
    title=_tag("h3", r"data-testid=[\"']ts-tsTitle[\"']"), subtitle=_tag("p", r"data-testid=[\"']ts-tsSubtitle[\"']"), link=r"data-testid=[\"']ts-tsItemLink[\"']", link_needed=True,
    first=300, morning=360, evening=1080, exact_url=True, dated_title=False, url_prefix="/fr/videos/",
)
PORTAL_GUIDE = GuideLayout(
    opening=r"(?i)<li\b[^>]*class=[\"']tvgrid-broadcast__item[\"'][^>]*>", counted=r"(?i)class=[\"']tvgrid-broadcast__details-time[\"']", closing=None, time=r"(?is)class=[\"']tvgrid-broadcast__details-time[\"'][^>]*>(.*?)</div>",
    title=r"(?is)class=[\"']tvgrid-broadcast__details-title[\"'][^>]*>(.*?)</div>", subtitle=r"(?is)class=[\"']tvgrid-broadcast__details-season[\"'][^>]*>(.*?)</div>", link="", link_needed=False,
    first=0, morning=480, evening=1080, exact_url=False, dated_title=True, url_prefix="/",
)


def _dates_named(day: Column) -> list[Column]:
    """The ways in which a page's title names its day: weekday, day and month, with 1er for the first."""
    month = F.element_at(F.array(*map(F.lit, FRENCH_MONTHS)), F.month(day))
    ways = [F.concat_ws(" ", weekday_name(day), F.dayofmonth(day).cast("string"), month)]
    return [*ways, F.when(F.dayofmonth(day) == 1, F.concat_ws(" ", weekday_name(day), F.lit("1er"), month))]


def guide_list(captures: DataFrame, layout: GuideLayout) -> DataFrame:
    """Programmes and errors of guide pages: ``capture_id, channel, row, date, start_min, title, subtitle, link, error``.

    ``captures`` has ``capture_id, url, channel, date, body``. A page that is a challenge,
    isn't the page asked for (canonical URL, date in its title) or has no items is void
    and gives one row with an ``error`` and no ``row``; a truncated page gives such a row
    beside its items. An item without a time, title or needed link, or out of order, has
    an error of its own; `rejected` parts the two. Times stand in the order of a broadcast
    day: the first step back turns to the next day, if it leads from the evening to the
    early morning; a second one is an error, and a time in error is passed over by the
    next. Null bodies count as empty.
    """
    body = F.coalesce("body", F.lit(""))
    pick = lambda c, pattern: F.regexp_extract(c, pattern, 1)
    links = F.filter(F.regexp_extract_all(body, F.lit(r"(?i)<link\b[^>]*>"), 0), lambda t: t.rlike(r"""(?i)\brel=["']canonical["']"""))
    canonical = decode_entities(pick(F.get(links, F.lit(0)), r"""(?i)\bhref=["']([^"']*)["']"""))
    folded = (lambda c: c) if layout.exact_url else F.lower
    heading = F.lower(html_text(pick(body, r"(?is)<title\b[^>]*>(.*?)</title>")))
    visible = html_text(F.regexp_replace(body, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", ""))
    pieces = F.slice(F.split(body, layout.opening), 2, 1 << 30)
    whole = F.filter(pieces, lambda p: F.contains(F.lower(p), F.lit(layout.closing))) if layout.closing else pieces
    items = F.transform(whole, lambda p: F.substring_index(p, layout.closing, 1)) if layout.closing else whole
    void = F.when(visible.rlike(UNAVAILABLE) | body.rlike(CHALLENGE), "unavailable_page").when(~F.coalesce(folded(canonical) == folded(F.col("url")), F.lit(False)), "canonical_mismatch")
    if layout.dated_title:
        named = F.exists(F.array(*_dates_named(F.col("date"))), lambda d: F.coalesce(F.contains(heading, F.concat(F.lit(" "), d, F.lit(" |"))), F.lit(False)))
        void = void.when(~named, "date_mismatch")
    page = captures.select("capture_id", "url", "channel", "date", items.alias("items"), void.when(F.size(items) == 0, "no_rows").alias("void"), F.size(F.regexp_extract_all(body, F.lit(layout.counted), 0)).alias("counted"))
    page = page.withColumn("starts", F.transform("items", lambda i: minutes(html_text(pick(i, layout.time)))))
    none = F.struct(F.lit(-1).alias("previous"), F.lit(0).alias("turns"), F.lit(0).alias("day"), F.array().cast("array<struct<day:int,error:string>>").alias("out"))

    def place(so_far: Column, start: Column) -> Column:
        back = F.coalesce(start < so_far["previous"], F.lit(False))
        turns = so_far["turns"] + back.cast("int")
        error = (
            F.when(start.isNull(), "time_missing").when((F.size(so_far["out"]) == 0) & (start < layout.first), "first_time").when(back & (turns > 1), "second_rollover")
            .when(back & ((start >= layout.morning) | (so_far["previous"] < layout.evening)), "implausible_order")
        )
        day = F.when(back & error.isNull(), 1).otherwise(so_far["day"])
        return F.struct(F.when(error.isNull(), start).otherwise(so_far["previous"]).alias("previous"), turns.alias("turns"), day.alias("day"), F.concat(so_far["out"], F.array(F.struct(day.alias("day"), error.alias("error")))).alias("out"))

    page = page.withColumn("placed", F.aggregate("starts", none, place)["out"])
    each = page.where("void IS NULL").select("capture_id", "url", "channel", "date", "starts", "placed", F.posexplode("items").alias("row", "i"))
    at = F.get("placed", F.col("row"))
    tags = F.regexp_extract_all("i", F.lit(r"(?is)<a\b[^>]*>"), 0)
    mine = F.filter(tags, lambda t: t.rlike(layout.link)) if layout.link else tags
    hrefs = F.filter(F.transform(mine, lambda t: decode_entities(pick(t, r"""(?is)\bhref=["']([^"']*)["']"""))), lambda h: F.startswith(h, F.lit(layout.url_prefix)))
    href = F.get(F.slice(hrefs, 1, 1), F.lit(0))
    title = html_text(pick("i", layout.title))
    error = F.coalesce(at["error"], F.when(href.isNull(), "link_missing") if layout.link_needed else F.lit(None).cast("string"), F.when(title == "", "title_missing"))
    site = F.regexp_extract("url", r"^([A-Za-z]+://[^/]+)", 1)
    rows = each.select(
        "capture_id", "channel", "row", F.date_add("date", at["day"]).alias("date"), F.get("starts", F.col("row")).alias("start_min"), title.alias("title"), html_text(pick("i", layout.subtitle)).alias("subtitle"),
        F.concat(site, href).alias("link"), error.alias("error"),
    )
    truncated = F.when(F.col("void").isNull() & (F.col("counted") != F.size("items")), F.concat_ws(" ", F.lit("truncated_rows"), F.size("items").cast("string"), F.lit("of"), F.col("counted").cast("string")))
    whole_page = page.select("capture_id", "channel", F.col("date"), F.coalesce("void", truncated).alias("error")).where("error IS NOT NULL")
    return rows.unionByName(whole_page, allowMissingColumns=True)


def offset_layout(captures: DataFrame) -> DataFrame:
    """Items with offset timestamps, as Paris dates and minutes."""
    each = captures.select("capture_id", "channel", F.posexplode(F.regexp_extract_all("body", F.lit(r'(?s)(<article[^>]*data-start="[^"]+".*?</article>)'), 1)).alias("pos", "h"))
    at = F.try_to_timestamp(F.regexp_extract("h", r'data-start="([^"]+)"', 1))
    day, minute = paris(at)
    return each.select("capture_id", "channel", "pos", day.alias("date"), minute.alias("start_min"), html_text(F.regexp_extract("h", r"(?s)<h3[^>]*>(.*?)</h3>", 1)).alias("title")).where("date IS NOT NULL")


def xml_layout(captures: DataFrame) -> DataFrame:
    """XML grids, with Spark's own XML parser."""
    doc = F.from_xml("body", "diffusion array<struct<date:string,heure:string,titre:string>>")
    each = captures.select("capture_id", "channel", F.posexplode(doc["diffusion"]).alias("pos", "i"))
    return each.select("capture_id", "channel", "pos", F.col("i.date").try_cast("date").alias("date"), minutes(F.col("i.heure")).alias("start_min"), F.trim("i.titre").alias("title"))


def json_layout(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paginated JSON: rows, and a row of pagination per capture."""
    doc = F.from_json("body", "page int, total_pages int, total_products int, products array<struct<title:string,start:string>>")
    d = captures.select("capture_id", "channel", "date", doc.alias("j"))
    rows = d.select("capture_id", "channel", "date", F.posexplode("j.products").alias("pos", "i")).select("capture_id", "channel", "date", "pos", minutes(F.col("i.start")).alias("start_min"), F.col("i.title").alias("title"))
    pages = d.select("capture_id", F.col("channel").alias("source"), "date", F.col("j.page").alias("page"), F.col("j.total_pages").alias("total_pages"), F.col("j.total_products").alias("total_products"), F.coalesce(F.size("j.products"), F.lit(0)).alias("n"))
    return rows, pages


def cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """Articles of a page: class, title, work id and text."""
    each = pages.select("page_key", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?s)(<article.*?</article>)"), 1)).alias("pos", "h"))
    get = lambda p: F.nullif(F.regexp_extract("h", p, 1), F.lit(""))
    return each.select("page_key", "pos", get(r'^<article[^>]*class="([^"]*)"').alias("card_class"), html_text(get(r"(?s)<h[1-4][^>]*>(.*?)</h[1-4]>")).alias("title"), get(r'data-work-id="([^"]*)"').alias("work_id"), F.size(F.regexp_extract_all("h", F.lit(r"(<p[ >])"), 1)).alias("paragraphs"))


def grid_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Time, channel, programme and reason cells of grid rows."""
    each = pages.select("page_key", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?s)(<tr>.*?</tr>)"), 1)).alias("pos", "h"))
    cell = lambda k: html_text(F.regexp_extract("h", rf'(?s)<td class="{k}">(.*?)</td>', 1))
    return each.where(F.contains("h", F.lit('class="prog"'))).select("page_key", "pos", cell("time").alias("time"), cell("chan").alias("channel"), cell("prog").alias("programme"), cell("why").alias("reason"))


def page_facts(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Typed facts of web pages, one row each: JSON-LD (object, list or ``@graph``), meta tags, title, language and canonical URL."""
    p = pages.select("page_key", F.col(html).alias("h"))
    none = F.lit(None).cast("string")
    fact = lambda name, v: F.struct(F.lit(name).alias("fact"), v.alias("value"))
    one = lambda pattern: F.nullif(F.regexp_extract("h", pattern, 1), F.lit(""))
    simple = F.array(fact("title", html_text(one(r"(?is)<title[^>]*>(.*?)</title>"))), fact("lang", one(r'(?i)<html[^>]*\blang="([^"]+)"')), fact("canonical", one(r'(?i)<link[^>]*rel="canonical"[^>]*href="([^"]+)"')), fact("og:image", one(r'(?i)<meta[^>]*property="og:image"[^>]*content="([^"]+)"')))
    flat = p.select("page_key", F.explode(F.filter(simple, lambda x: x["value"].isNotNull())).alias("f")).select("page_key", "f.*")
    blocks = p.select("page_key", F.explode(F.regexp_extract_all("h", F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1)).alias("b"))
    node = "struct<name:string,datePublished:string,duration:string,`@type`:string>"
    parsed = blocks.select("page_key", F.coalesce(F.from_json("b", f"struct<`@graph`:array<{node}>>")["@graph"], F.when(F.startswith(F.trim("b"), F.lit("[")), F.from_json("b", f"array<{node}>")), F.array(F.from_json("b", node))).alias("g"))
    each = parsed.select("page_key", F.explode("g").alias("n"))
    ld = each.select("page_key", F.explode(F.array(*[fact(f"ld:{k}", F.coalesce(F.col(f"n.{k}"), none)) for k in ("name", "datePublished", "duration")])).alias("f")).select("page_key", "f.*").where("value IS NOT NULL")
    return flat.unionByName(ld)


def by_adapter(captures: DataFrame, adapter: str) -> DataFrame:
    """Captures of one adapter; cheap before any parsing."""
    return captures.where(F.col("adapter") == adapter)


def rejected(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Rows split by an error-code column: good ones, and rejected ones with their ``reason``."""
    marked = rows.withColumn("reason", error)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")
