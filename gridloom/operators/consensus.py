"""Facts from several sources, and guarded updates of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.keys import match_key
from gridloom.functions.parse import split_names


def merge_facts(facts: DataFrame, rules: dict[str, str], catalogue: DataFrame | None = None) -> DataFrame:
    """Per work and field one value or a conflict.

    ``facts`` has ``work_id, field, source, ladder, value``. Rules tell when a value
    agrees with that of the first source of the ladder, which gives the value: ``equal``
    (default), ``set`` (same names in any order), ``share`` (a name in common with it).
    ``status``: agreed, single or conflict; with a ``catalogue`` (``work_id, field,
    current``) what stands there decides: proposed (nothing does), agrees, differs or
    conflict.
    """
    rule = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (rules or {"": ""}).items() for x in kv]), F.col("field")), F.lit("equal"))
    names = lambda v: F.array_sort(F.array_distinct(F.transform(split_names(v), match_key)))
    norm = lambda v: F.when(F.col("rule") == "equal", F.array(match_key(v))).otherwise(names(v))
    same = lambda a, b: F.when(F.col("rule") == "share", F.arrays_overlap(a, b)).otherwise(a == b)
    rows = facts.where("trim(value) <> ''").withColumn("rule", rule)
    rows = rows.withColumn("norm", norm(F.col("value")))
    g = rows.groupBy("work_id", "field", "rule").agg(F.min(F.struct("ladder", "source", "value", "norm")).alias("first"), F.countDistinct("source").alias("n_sources"), F.collect_set("norm").alias("norms"))
    agree = F.forall("norms", lambda x: same(x, F.col("first.norm")))
    if catalogue is None:
        status = F.when(F.col("n_sources") == 1, "single").when(agree, "agreed").otherwise("conflict")
    else:
        g = g.join(catalogue.select("work_id", "field", "current"), ["work_id", "field"], "left")
        status = F.when(~agree, "conflict").when(F.coalesce(F.trim("current"), F.lit("")) == "", "proposed").when(same(norm(F.col("current")), F.col("first.norm")), "agrees").otherwise("differs")
    return g.select("work_id", "field", F.when(status != "conflict", F.col("first.value")).alias("value"), "n_sources", status.alias("status"))


def merge_ratings(proposed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Proposed, agrees, differs or blocked (the catalogue says that there is none)."""
    j = proposed.join(catalogue, ["work_id", "publisher"], "left")
    status = F.when(F.col("blocked_reason").isNotNull(), "blocked").when(F.col("current").isNull(), "proposed").when(F.abs(F.col("current") - F.col("proposed")) < 0.05, "agrees").otherwise("differs")
    return j.withColumn("status", status)


def year_spread(years: DataFrame) -> DataFrame:
    """Spread of source years without a catalogue year, and sources more than two years off one that is there: ``problem``."""
    g = years.groupBy("work_id").agg(F.max("year").alias("hi"), F.min("year").alias("lo"), F.max("catalogue_year").alias("cy"))
    spread = g.where("cy IS NULL AND hi - lo > 2").select("work_id", F.lit(None).cast("string").alias("source"), F.lit("identity_conflict").alias("problem"))
    off = years.where("catalogue_year IS NOT NULL AND abs(year - catalogue_year) > 2").select("work_id", "source", F.lit("year_mismatch").alias("problem"))
    return spread.unionByName(off)


#: Fields that a work needs; a creator stands for a director.
NEEDED = ("year", "director", "country", "genre", "duration", "image")


def fill_gaps(works: DataFrame, offers: DataFrame, dossiers: DataFrame, preferred: tuple[str, str] = ("senscritique", "SensCritique")) -> DataFrame:
    """``works`` with empty fields filled, what was filled and from where (``changes``), and the ``open_fields`` that are left.

    ``works`` has ``work_id``, the needed fields and ``creator``; ``offers`` the values on
    which sources differ, ``work_id, field, source, value, url, pos``, one a source;
    ``dossiers`` at most one row a work, ``work_id, country, minutes, url``. A duration
    is the preferred source's, with the others quoted in it, else the dossier's; a year
    the one that the work's id ends in, if a source has it; a country the dossier's. A
    field that is there is never changed.
    """
    offer = F.struct("pos", "source", "value", "url")
    listed = offers.groupBy("work_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("field") == f, offer))).alias(f"_{f}") for f in ("duration", "year")])
    j = works.join(listed, "work_id", "left").join(dossiers.select("work_id", F.col("country").alias("_country"), F.col("minutes").alias("_minutes"), F.col("url").alias("_url")), "work_id", "left")
    empty = lambda f: F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == ""
    quoted = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(" ", x["source"], x["value"])), ", ")
    read = F.get(F.filter("_duration", lambda x: x["source"] == preferred[0]), F.lit(0))
    others = F.filter("_duration", lambda x: x["source"] != preferred[0])
    own = F.concat(read["value"], F.when(F.size(others) > 0, F.concat(F.lit(f" ({preferred[1]} ; "), quoted(others), F.lit(")"))).otherwise(""))
    expected = F.regexp_extract(F.col("work_id").cast("string"), r"-(\d{4})$", 1)
    dated = F.get(F.filter("_year", lambda x: x["value"] == expected), F.lit(0))
    minutes = F.concat(F.col("_minutes").cast("string"), F.lit(" min"))
    country = F.replace("_country", F.lit(", "), F.lit(" / "))
    filled = {
        "duration": (F.coalesce(own, minutes), F.coalesce(read["url"], F.col("_url")), F.when(own.isNotNull(), read["source"]).otherwise("dossier")),
        "year": (dated["value"], dated["url"], dated["source"]),
        "country": (country, F.col("_url"), F.lit("dossier")),
    }
    change = lambda f: F.when(empty(f) & filled[f][0].isNotNull(), F.struct(F.lit(f).alias("field"), *[c.alias(n) for n, c in zip(("value", "url", "basis"), filled[f], strict=True)]))
    j = j.withColumn("changes", F.array_compact(F.array(*[change(f) for f in ("country", "duration", "year")])))
    kinds = dict(works.dtypes)
    new = {f: F.when(empty(f), filled[f][0].cast(kinds[f])).otherwise(F.col(f)) for f in filled}
    j = j.withColumns(new)
    lacks = [F.when(empty(f) & (empty("creator") if f == "director" else F.lit(True)), F.lit(f)) for f in NEEDED]
    return j.select(*works.columns, "changes", F.array_compact(F.array(*lacks)).alias("open_fields"))


def summarise(results: DataFrame) -> DataFrame:
    """Counts by status, by field, and in all, in one pass."""
    return results.groupingSets([["status"], ["field"], []], "status", "field").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def fill_empty(works: DataFrame, found: DataFrame, dependants: dict[str, list[str]]) -> DataFrame:
    """Only empty fields are filled; a field that is not filled blocks its dependants.

    ``found`` has ``id`` and the fields. ``filled`` lists what was taken.
    """
    new = found.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_n_{c}") for c in found.columns if c != "id"])
    j = works.join(new, works["id"] == new["_id"], "left")
    taken = []
    for f, deps in dependants.items():
        empty = F.coalesce(F.trim(F.col(f)) == "", F.lit(True)) & F.col(f"_n_{f}").isNotNull()
        j = j.withColumn(f"_t_{f}", empty)
        for c in [f, *deps]:
            j = j.withColumn(c, F.when(F.col(f"_t_{f}"), F.coalesce(F.col(f"_n_{c}"), F.col(c))).otherwise(F.col(c)))
        taken.append(F.when(F.col(f"_t_{f}"), F.lit(f)))
    return j.select(*works.columns, F.array_join(F.array_sort(F.array_compact(F.array(*taken))), ",").alias("filled"))


def upsert_works(catalogue: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New works are inserted, existing ones only gain link keys they lack; different values of a key are the second table.

    Both tables have ``id, title, links``. A replay changes nothing.
    """
    p = plan.select(F.col("id").alias("pid"), F.col("title").alias("pt"), F.col("links").alias("pl"))
    j = catalogue.join(p, F.col("id") == F.col("pid"), "full_outer")
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("links", none), F.coalesce("pl", none)
    merged = F.map_concat(old, F.map_filter(new, lambda k, _: ~F.map_contains_key(old, k)))
    out = j.select(F.coalesce("id", "pid").alias("id"), F.coalesce("title", "pt").alias("title"), merged.alias("links"))
    differ = j.where("id IS NOT NULL AND pid IS NOT NULL").select("id", F.explode(F.map_entries(new)).alias("e"), old.alias("o"))
    differ = differ.select("id", F.col("e.key").alias("key"), F.try_element_at("o", F.col("e.key")).alias("current"), F.col("e.value").alias("proposed"))
    return out, differ.where("current <> proposed")


def image_decision(probes: DataFrame) -> DataFrame:
    """Keep, repair or add: first working source by ladder, then two fallbacks, another host first; failed URLs are never used.

    ``probes`` has ``work_id, url, host, ladder, ok, is_primary``.
    """
    works = probes.groupBy("work_id").agg(
        F.max(F.when(F.col("is_primary"), F.col("ok").cast("int"))).alias("primary_ok"), F.max(F.when(F.col("is_primary"), F.col("url"))).alias("primary"),
        F.min_by("host", F.struct((~F.col("is_primary")).alias("a"), "ladder")).alias("main_host"), F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct("ladder", "url", "host")))).alias("good"),
    )
    first = F.when(F.col("primary_ok") == 1, F.col("primary")).otherwise(F.get("good", 0)["url"])
    status = F.when(F.col("primary_ok") == 1, "keep").when(F.size("good") == 0, "unresolved").when(F.col("primary").isNull(), "add").otherwise("repair")
    rest = F.filter("good", lambda g: g["url"] != F.col("image"))
    ordered = F.concat(F.filter(rest, lambda g: g["host"] != F.col("main_host")), F.filter(rest, lambda g: g["host"] == F.col("main_host")))
    out = works.withColumn("status", status).withColumn("image", first)
    return out.select("work_id", "status", "image", F.coalesce(F.array_join(F.slice(F.transform(ordered, lambda g: g["url"]), 1, 2), ","), F.lit("")).alias("fallbacks"))
