"""Catalogue identity: title and alias joins, id ownership, match ladders.

No join here is an OR of two keys: each key is an equi join of its own, and the
branches are united. Duplicate keys state which row wins, by a position column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.keys import fresh_key, library_key, match_key
from gridloom.functions.parse import external_id, title_variants
from gridloom.staging import small, staged


def last_wins(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """One row of each key: that with the highest position."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), pos).alias("_r")).select(key, *[F.col(f"_r.{c}") for c in rest])


def first_wins(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """One row of each key: that with the lowest position."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), pos).alias("_r")).select(key, *[F.col(f"_r.{c}") for c in rest])


def by_title(rows: DataFrame, works: DataFrame, pos: str = "pos") -> DataFrame:
    """Left join by title key; of works that share it the last one wins."""
    index = last_wins(works.select(fresh_key(F.col("title")).alias("_k"), F.col("id").alias("work_id"), pos), "_k", pos).drop(pos)
    return rows.join(index, fresh_key(rows["title"]) == index["_k"], "left").drop("_k")


def alias_index(works: DataFrame) -> DataFrame:
    """Every title or alias key with the sorted ids that bear it and how many."""
    names = works.select("id", F.explode(F.array_union(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    keyed = names.select(match_key(F.col("name")).alias("title_key"), "id").where("title_key <> ''").distinct()
    return keyed.groupBy("title_key").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count("*").alias("n_matches"))


def resolve(rows: DataFrame, works: DataFrame) -> DataFrame:
    """``work_id`` and ``reason``: a stated id must agree with the title; else the title, narrowed by year, then director.

    Reasons: ``id``, ``id_unknown``, ``id_title_conflict``, ``title``, ``title_year``,
    ``title_director``, ``ambiguous``, ``unmatched``.
    """
    names = works.select(F.col("id").alias("cid"), F.col("year").alias("cy"), match_key(F.col("director")).alias("cd"), F.explode(F.array_union(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    names = names.select("cid", "cy", "cd", match_key(F.col("name")).alias("ck")).distinct()
    keyed = rows.withColumn("_k", match_key(F.col("title"))).withColumn("_d", match_key(F.col("director")))
    of = names.groupBy(F.col("cid").alias("_id")).agg(F.collect_set("ck").alias("_names"))
    stated = keyed.where("work_ref IS NOT NULL").join(of, F.col("work_ref") == F.col("_id"), "left")
    reason = F.when(F.col("_id").isNull(), "id_unknown").when(F.array_contains("_names", F.col("_k")), "id").otherwise("id_title_conflict")
    stated = stated.withColumn("reason", reason).withColumn("work_id", F.when(F.col("reason") == "id", F.col("work_ref")))
    # works are counted before they meet the rows: whether there is none, one or several shows in the least and the greatest
    found = keyed.where("work_ref IS NULL")
    for x, also in (("t", {}), ("y", {"cy": "year"}), ("d", {"cd": "_d"})):
        ends = names.groupBy(F.col("ck").alias(f"_k{x}"), *[F.col(c).alias(f"_{c}") for c in also]).agg(F.min("cid").alias(x), F.max("cid").alias(f"{x}_hi"))
        on = F.col("_k") == F.col(f"_k{x}")
        for c, mine in also.items():
            on = on & (F.col(mine) == F.col(f"_{c}"))
        found = found.join(ends, on, "left")
    one = lambda c: F.col(c) == F.col(f"{c}_hi")
    reason = F.when(F.col("t").isNull(), "unmatched").when(one("t"), "title").when(one("y"), "title_year").when(one("d"), "title_director").otherwise("ambiguous")
    work = F.when(F.col("reason") == "title", F.col("t")).when(F.col("reason") == "title_year", F.col("y")).when(F.col("reason") == "title_director", F.col("d"))
    found = found.withColumn("reason", reason).withColumn("work_id", work)
    own = [*[F.col(f"`{c}`") for c in rows.columns], "reason", "work_id"]
    return stated.select(*own).unionByName(found.select(*own))


def id_then_title(rows: DataFrame, works: DataFrame, pos: str = "pos") -> DataFrame:
    """The work of the id, else that of the title (the last of equal titles)."""
    ids = works.select(F.col("id").alias("_by_id")).distinct()
    titled = last_wins(works.select(fresh_key(F.col("title")).alias("_k"), F.col("id").alias("_by_title"), pos), "_k", pos).drop(pos)
    out = rows.join(ids, rows["work_ref"] == ids["_by_id"], "left").join(titled, fresh_key(rows["title"]) == titled["_k"], "left")
    return out.withColumn("work_id", F.coalesce("_by_id", "_by_title")).drop("_by_id", "_by_title", "_k")


def named_lookup(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence by id, or by title where the evidence has no id: two equi joins without a common row. Both sides are distinct before them, so the pairs, which may be many, are distinct without a shuffle of their own."""
    rows, evidence = rows.distinct(), evidence.distinct()
    by_id = rows.join(evidence.where("e_work_id IS NOT NULL"), F.col("work_id") == F.col("e_work_id"))
    by_key = rows.join(evidence.where("e_work_id IS NULL"), F.col("title_key") == F.col("e_title_key"))
    return by_id.unionByName(by_key)


def legacy_lookup(refs: DataFrame, works: DataFrame) -> DataFrame:
    """Canonical id of any id, current or legacy; a current one comes first."""
    ids = works.select(F.col("id").alias("any_id"), "id", F.lit(0).alias("o")).union(works.select(F.explode("legacy_ids").alias("any_id"), "id", F.lit(1).alias("o")))
    best = ids.groupBy("any_id").agg(F.min(F.struct("o", "id")).alias("b")).select("any_id", F.col("b.id").alias("id"))
    return refs.join(best, refs["ref"] == best["any_id"], "left").drop("any_id")


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join on ``keys``, of which nulls are equal."""
    other = b.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in b.columns])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(other, on).drop(*[f"_{c}" for c in keys])


def sharing(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """``row_id, candidate, n``: with how many candidates (``candidate, key``) a row (``row_id, key``) has a key in common, and the least of them.

    Rows with the same set of keys are one kind, as are candidates. Kinds meet, and a
    kind brings the number of its candidates along: a key that n rows and n candidates
    have never makes n times n pairs. Null keys are none.
    """
    of = lambda t, own: t.where(F.col("key").isNotNull() & F.col(own).isNotNull()).groupBy(own).agg(F.sort_array(F.collect_set("key")).alias("keys"))
    mine = of(rows, "row_id")
    theirs = of(candidates, "candidate").groupBy(F.col("keys").alias("their")).agg(F.min("candidate").alias("candidate"), F.count("*").alias("n"))
    met = mine.select("keys").distinct().select("keys", F.explode("keys").alias("key")).join(theirs.select("*", F.explode("their").alias("key")), "key")
    each = met.groupBy("keys", "their").agg(F.min("candidate").alias("candidate"), F.max("n").alias("n"))
    per = each.groupBy("keys").agg(F.min("candidate").alias("candidate"), F.sum("n").alias("n"))
    return mine.join(per, "keys").select("row_id", "candidate", "n")


def ladder(rows: DataFrame, rungs: list[DataFrame], key: str = "row_id") -> DataFrame:
    """Candidates of several rungs (``row_id, candidate``); the first rung with any decides.

    ``basis`` is the rung's number from 1, ``candidate`` set only if the rung has
    exactly one, ``n`` how many it has. Rows that no rung knows have basis null. A rung
    with a column ``n`` has been counted, as by `sharing`, and has a row a row.
    """
    each = lambda rung: rung if "n" in rung.columns else rung.groupBy(key).agg(F.min("candidate").alias("candidate"), F.countDistinct("candidate").alias("n"))
    per = None
    for k, rung in enumerate(rungs, 1):
        counted = each(rung).select(key, F.lit(k).alias("basis"), "candidate", "n")
        per = counted if per is None else per.unionByName(counted)
    best = per.groupBy(key).agg(F.min(F.struct("basis", "candidate", "n")).alias("b"))
    best = best.select(key, F.col("b.basis").alias("basis"), F.when(F.col("b.n") == 1, F.col("b.candidate")).alias("candidate"), F.col("b.n").alias("n"))
    return rows.join(best, key, "left")


def counted_ladder(rows: DataFrame, rungs: list[tuple[dict[str, Column], DataFrame]]) -> DataFrame:
    """As `ladder`, for rungs of keys: ``({key: expression over rows}, candidates)``, candidates with ``candidate`` and a column of each key.

    Candidates are counted per key before they meet the rows, so that a join gives one
    row a row: a slot with n rows on either side never makes n times n pairs.
    """
    out = rows
    for k, (keys, candidates) in enumerate(rungs):
        counted = candidates.groupBy(*[F.col(c).alias(f"_{k}_{c}") for c in keys]).agg(F.min("candidate").alias(f"_c{k}"), F.countDistinct("candidate").alias(f"_n{k}"))
        met = None
        for c, mine in keys.items():
            met = (mine == F.col(f"_{k}_{c}")) if met is None else met & (mine == F.col(f"_{k}_{c}"))
        out = out.join(counted, met, "left").drop(*[f"_{k}_{c}" for c in keys])
    basis = F.coalesce(*[F.when(F.col(f"_n{k}") > 0, k + 1) for k in range(len(rungs))])
    first = lambda c: F.coalesce(*[F.when(F.col(f"_n{k}") > 0, F.col(f"_{c}{k}")) for k in range(len(rungs))])
    out = out.withColumn("basis", basis).withColumn("n", first("n")).withColumn("candidate", F.when(F.col("n") == 1, first("c")))
    return out.drop(*[f"_{c}{k}" for c in "cn" for k in range(len(rungs))])


def review_ladder(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Title, as printed or as corrected, at its slot; else the only review of the slot, else the only review of title, channel and day."""
    r = reviews.select("date", "start_min", "channel", F.explode(F.array_distinct(F.array_compact(F.array("title_key", "reviewed_key")))).alias("title_key"), F.col("review_id").alias("candidate"))
    by = lambda *keys: ({c: F.col(c) for c in keys}, r)
    return counted_ladder(rows, [by("date", "start_min", "channel", "title_key"), by("date", "start_min", "channel"), by("date", "channel", "title_key")])


def slot_ladder(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """Same start, channel and compact title; else the single row of the slot."""
    compact = F.replace("title_key", F.lit(" "), F.lit(""))
    inv = inventory.select("date", "start_min", "channel", compact.alias("compact"), F.col("row_id").alias("candidate"))
    slot = {c: F.col(c) for c in ("date", "start_min", "channel")}
    return counted_ladder(rows, [(slot | {"compact": compact}, inv), (slot, inv)])


def dossier_ladder(dossiers: DataFrame, works: DataFrame) -> DataFrame:
    """Exact link, else same title and year."""
    links = lambda t, own: t.select(F.col(own).alias("x"), F.explode(F.map_values("links")).alias("key"))
    titled = lambda t, own: t.select(F.col(own).alias("x"), match_key(F.col("title")).alias("k"), F.col("year").alias("y")).where("k IS NOT NULL AND y IS NOT NULL").select("x", F.struct("k", "y").alias("key"))
    return ladder(dossiers, [sharing(of(dossiers, "row_id").withColumnRenamed("x", "row_id"), of(works, "id").withColumnRenamed("x", "candidate")) for of in (links, titled)])


def pick_plan(picks: DataFrame, works: DataFrame, dossiers: DataFrame) -> DataFrame:
    """``status`` of each pick: explicit, dossier, repeat, clash, needs_year or needs_dossier."""
    k = picks.withColumn("_k", match_key(F.col("title")))
    first = F.row_number().over(Window.partitionBy("_k").orderBy("pick_pos")) == 1
    named = works.groupBy(match_key(F.col("title")).alias("_k")).agg(F.countDistinct("id").alias("n_works"))
    known = dossiers.groupBy(match_key(F.col("title")).alias("_k")).agg(F.max("year").alias("dossier_year"), F.lit(True).alias("has_dossier"))
    out = k.withColumn("_first", first).join(named, "_k", "left").join(known, "_k", "left")
    status = (
        F.when(F.col("work_id").isNotNull(), "explicit").when(~F.col("_first"), "repeat").when(F.coalesce("n_works", F.lit(0)) > 1, "clash")
        .when(F.col("has_dossier").isNull(), "needs_dossier").when(F.col("dossier_year").isNull(), "needs_year").otherwise("dossier")
    )
    return out.withColumn("status", status).drop("_k", "_first", "n_works", "dossier_year", "has_dossier")


def id_owners(links: DataFrame) -> DataFrame:
    """Per external id the number of works that claim it, and the owner if there is one."""
    ids = links.withColumn("_e", external_id(F.col("url"))).where("_e IS NOT NULL").select("work_id", F.col("_e.provider").alias("provider"), F.col("_e.ext_id").alias("ext_id")).distinct()
    return ids.groupBy("provider", "ext_id").agg(F.count("*").alias("claims"), F.when(F.count("*") == 1, F.min("work_id")).alias("owner"))


def identity_conflicts(links: DataFrame) -> DataFrame:
    """Works with two ids of one provider."""
    ids = links.withColumn("_e", external_id(F.col("url"))).where("_e IS NOT NULL").select("work_id", F.col("_e.provider").alias("provider"), F.col("_e.ext_id").alias("ext_id")).distinct()
    return ids.groupBy("work_id", "provider").agg(F.count("*").alias("n_ids")).where("n_ids > 1")


def scoped_records(records: DataFrame, obs: DataFrame) -> DataFrame:
    """Records of a title that apply to its observations: equi join on the title, wildcard scopes as a residual. Stable fields cross scopes."""
    fits = (F.col("r_date").isNull() | (F.col("r_date") == F.col("date"))) & (F.col("r_channel").isNull() | (F.col("r_channel") == F.col("channel")))
    return obs.join(records, F.col("title_key") == F.col("r_title_key")).where(fits | (F.col("stability") == "stable"))


def _inside(a: Column, b: Column) -> Column:
    """Whether the words of ``b`` stand together in ``a``."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return F.contains(pad(a), pad(b))


def _rarest_word(names: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """``names`` with ``word``, that word of ``key`` which the fewest of the ``texts`` have."""
    counts = texts.select(F.explode(F.array_distinct(F.split(text, " "))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    each = names.select(key).distinct().select(key, F.explode(F.array_distinct(F.split(key, " "))).alias("word")).join(counts, "word", "left")
    rarest = each.groupBy(key).agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("r")).select(F.col(key).alias("_key"), F.col("r.word").alias("word"))
    return names.join(rarest, F.col(key) == F.col("_key")).drop("_key")


def phrase_containment(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Names of any length inside free text at word boundaries: ``text_id, name_id``.

    A name is its adjacent word pairs at their offsets (a single word is a gram of its
    own). Texts give postings, ``gram, text_id, pos``, of the grams that names have, and
    no text is shuffled: names meet the postings of their rarest gram, and each place
    found there must have the other grams where they belong. Empty names match nothing.
    """

    def grams(rows: DataFrame, key: Column) -> tuple[DataFrame, Column, Column]:
        # a projection with a non-deterministic column is computed once for all that reads it
        worded = rows.withColumn("_words", F.when(F.monotonically_increasing_id() >= 0, F.filter(F.split(match_key(key), " "), lambda w: w != "")))
        words = F.col("_words")
        pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b))
        placed = lambda grams: F.transform(grams, lambda g, i: F.struct(i.alias("pos"), g.alias("gram")))
        return worded, placed(pairs), placed(words)

    named, pairs, single = grams(names, F.col("name"))
    n_words = F.size("_words")
    n = named.select("name_id", F.explode(F.when(n_words > 1, pairs).otherwise(single)).alias("g"), F.greatest(n_words - 1, F.lit(1)).alias("length")).select("name_id", "length", F.col("g.pos").alias("at"), "g.gram")
    n = staged(n.distinct(), "names")
    worded, pairs, single = grams(texts.select("text_id", "text"), F.col("text"))
    every = worded.select("text_id", F.explode(F.concat(pairs, single)).alias("g")).select("text_id", "g.pos", "g.gram")
    postings = staged(every.join(small(n.select("gram")), "gram", "left_semi").distinct(), "postings")
    counts = postings.groupBy("gram").agg(F.count("*").alias("df"))
    rarest = n.join(counts, "gram").groupBy("name_id").agg(F.min(F.struct("df", "at", "gram")).alias("r"), F.count("*").alias("found"), F.max("length").alias("length"))
    # a name one of whose grams no text has is out
    start = rarest.where("found = length").select("name_id", "r.gram", "r.at", "length").join(postings, "gram")
    start = start.select("text_id", "name_id", (F.col("pos") - F.col("at")).alias("start"), "length").where("start >= 0")
    asked = start.join(n.drop("length"), "name_id").select("text_id", "name_id", "start", "length", "gram", (F.col("start") + F.col("at")).alias("pos"))
    held = asked.join(postings, ["text_id", "gram", "pos"]).groupBy("text_id", "name_id", "start", "length").agg(F.count("*").alias("n"))
    return held.where("n = length").select("text_id", "name_id").distinct()


def _strong(a: Column, b: Column) -> Column:
    """Whether the shorter of two names has 14 characters and three words."""
    shorter = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    return (F.length(shorter) >= 14) & (F.size(F.split(shorter, " ")) >= 3)


def _alike_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """``ak, bk, equal, strong``: the names of ``a`` and ``b``, each once, that are equal or of which one's words stand together in the other, wherever. Empty ones are like nothing."""
    a, b = a.select("ak").where("ak <> ''").distinct(), b.select("bk").where("bk <> ''").distinct()
    words = lambda t, key: t.select("*", F.explode(F.array_distinct(F.split(key, " "))).alias("word"))
    inner = _rarest_word(b, a, "bk", "ak").join(words(a, "ak"), "word").where((F.col("ak") != F.col("bk")) & _inside(F.col("ak"), F.col("bk")))
    outer = _rarest_word(a, b, "ak", "bk").join(words(b, "bk"), "word").where((F.col("ak") != F.col("bk")) & _inside(F.col("bk"), F.col("ak")))
    equal = a.join(b, F.col("ak") == F.col("bk")).select("ak", "bk", F.lit(True).alias("equal"))
    within = inner.select("ak", "bk").unionByName(outer.select("ak", "bk")).withColumn("equal", F.lit(False))
    return equal.unionByName(within).withColumn("strong", _strong(F.col("ak"), F.col("bk")))


def _named(items: DataFrame, lib: DataFrame) -> DataFrame:
    """``row_id, wide, candidate``: the candidate of equal names, and if ``wide`` of equal and strongly contained ones, by the year.

    It is the one of the exact year; several end it; else the one a year off; else the
    only one there is, if its year is unknown. Without a year the only one. Rows of the
    same names are one kind, as are candidates: kinds meet, with the number of candidates
    and the least of them, and never rows with candidates.
    """
    mine = items.where("_k <> ''").groupBy("row_id", "year").agg(F.sort_array(F.collect_set("_k")).alias("names"))
    theirs = lib.where("lk <> ''").groupBy("candidate", "ly").agg(F.sort_array(F.collect_set("lk")).alias("their")).groupBy("their", "ly").agg(F.min("candidate").alias("c"), F.count("*").alias("n"))
    a = mine.select("names").distinct().select("names", F.explode("names").alias("ak"))
    b = theirs.select("their").distinct().select("their", F.explode("their").alias("bk"))
    met = a.join(_alike_names(a, b).where("equal OR strong"), "ak").join(b, "bk").groupBy("names", "their").agg(F.max("equal").alias("equal"))
    wide = F.explode(F.when(F.col("equal"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True))))
    dated = met.withColumn("wide", wide).join(theirs, "their").groupBy("names", "wide", "ly").agg(F.min("c").alias("c"), F.sum("n").alias("n"))
    exact, near = F.col("ly") == F.col("year"), F.abs(F.col("ly") - F.col("year")) <= 1
    of = lambda cond, x: [F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(f"n_{x}"), F.min(F.when(cond, F.col("c"))).alias(f"c_{x}")]
    kinds = mine.select("names", "year").distinct().join(dated, "names").groupBy("names", "year", "wide").agg(F.sum("n").alias("n"), F.min("c").alias("c"), F.max("ly").alias("known"), *of(exact, "exact"), *of(near, "near"))
    sums = [F.sum(c).alias(c) for c in ("n", "n_exact", "n_near")] + [F.min(c).alias(c) for c in ("c", "c_exact", "c_near")]
    g = _null_safe(mine, kinds, ["names", "year"]).groupBy("row_id", "wide").agg(*sums, F.max("known").alias("known"), F.max("year").alias("year"))
    only = F.when(F.col("n") == 1, F.col("c"))
    chosen = F.when(F.col("year").isNull(), only).when(F.col("n_exact") > 0, F.when(F.col("n_exact") == 1, F.col("c_exact"))).when(F.col("n_near") == 1, F.col("c_near")).when(F.col("known").isNull(), only)
    return g.select("row_id", "wide", chosen.alias("candidate")).where("candidate IS NOT NULL")


def library_match(items: DataFrame, library: DataFrame) -> DataFrame:
    """Imdb id, tmdb id, equal name, then equal name or strong containment (14 characters, 3 words of the shorter) wherever it stands; names by the year, as `_named`. The first rung that settles on a candidate is the ``basis``, 1 to 4."""
    lib = library.select(F.col("lib_id").alias("candidate"), "imdb", "tmdb", F.col("year").alias("ly"), library_key(F.col("name")).alias("lk"))
    named = _named(items.select("row_id", "year", library_key(F.col("title")).alias("_k")), lib)
    by_id = [sharing(items.select("row_id", F.col(x).alias("key")), lib.select("candidate", F.col(x).alias("key"))) for x in ("imdb", "tmdb")]
    return ladder(items, [*by_id, named.where("NOT wide"), named.where("wide")])


#: Fixed values of J16 by profile. Titles: points of an exact, a strongly contained and a contained title, each with what a variant loses by rank. Years: same, next, other. Directors: same, other. Ids: imdb, tmdb. Least score.
PROFILES = {
    "web": {"exact": (85, 0), "strong": (45, 0), "inside": (45, 0), "year": (40, 8, -80), "director": (35, -20), "ids": (0, 0), "least": 70},
    "library": {"exact": (110, 8), "strong": (55, 5), "inside": (55, 5), "year": (35, 8, 0), "director": (0, 0), "ids": (0, 0), "least": 80},
    "browser": {"exact": (160, 8), "strong": (155, 5), "inside": (55, 5), "year": (60, 10, 0), "director": (0, 0), "ids": (1000, 900), "least": 80},
}


def _with_names(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The distinct ``fields`` of each ``key``, with all the ``names`` of its rows, sorted."""
    sets = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set(F.struct(*fields)).alias("_f"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"))
    return sets.select(key, "names", F.explode("_f").alias("_f")).select(key, "names", "_f.*")


def best_match(items: DataFrame, candidates: DataFrame, profile: str = "web") -> DataFrame:
    """The best candidate by score, where it reaches the profile's threshold. Pairs come from a shared id, or a title variant that is equal or one in the other, at word boundaries; variants count less by rank. A wrong year or director counts against a candidate where the profile says so.

    Of candidates that score alike the least is the best, so rows meet as kinds: those of
    the same title, director and year (and ids, where these count) are one. Of the candidates
    of a title the best of each director and year is kept, then, for each director of a row,
    that of each year.
    """
    w, ids = PROFILES[profile], any(PROFILES[profile]["ids"])
    tmdb = lambda t: F.col("tmdb") if "tmdb" in t.columns else F.lit(None).cast("string")
    variants = F.transform(title_variants(F.col("title")), lambda x, i: F.struct(match_key(x).alias("vk"), i.alias("rank")))
    own = items.select("row_id", variants.alias("names"), "year", match_key(F.col("director")).alias("dir"), "imdb", tmdb(items).alias("tmdb"))
    cand = candidates.select("cand_id", F.array_compact(F.array(match_key(F.col("title")))).alias("names"), F.col("year").alias("c_year"), match_key(F.col("director")).alias("c_dir"), F.col("imdb").alias("c_imdb"), tmdb(candidates).alias("c_tmdb"))
    fields = ["dir", "year", *(["imdb", "tmdb"] if ids else [])]
    mine = _with_names(own, "row_id", fields)
    theirs = _with_names(cand, "cand_id", [f"c_{c}" for c in fields]).withColumn("ck", F.explode_outer("names")).groupBy("ck", *[f"c_{c}" for c in fields]).agg(F.min("cand_id").alias("cand_id"))

    points = lambda kind, rank: F.lit(w[kind][0]) - w[kind][1] * rank
    of_kind = lambda equal, strong, rank: F.when(equal, points("exact", rank)).when(strong, points("strong", rank)).otherwise(points("inside", rank))
    apart = F.abs(F.col("year") - F.col("c_year"))
    by_year = F.when(apart == 0, w["year"][0]).when(apart == 1, w["year"][1]).when(apart > 1, w["year"][2]).otherwise(0)
    same = F.contains("dir", F.col("c_dir")) | F.contains("c_dir", F.col("dir"))
    by_director = F.when((F.col("dir") == "") | (F.col("c_dir") == ""), 0).when(same, w["director"][0]).when(~same, w["director"][1]).otherwise(0)

    def best(rows: DataFrame, score: Column, *key: str) -> DataFrame:
        return rows.withColumn("score", score).groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("loss"), "cand_id")).alias("b")).select(*key, (-F.col("b.loss")).alias("score"), "b.cand_id")

    each = mine.select("names").distinct().select("names", F.explode("names").alias("x")).select("names", "x.vk", "x.rank")
    alike = _alike_names(each.select(F.col("vk").alias("ak")), theirs.select(F.col("ck").alias("bk")))
    titled = each.join(alike, F.col("vk") == F.col("ak")).groupBy("names", F.col("bk").alias("ck")).agg(F.max(of_kind(F.col("equal"), F.col("strong"), F.col("rank"))).alias("score"))
    found = best(titled.join(theirs, "ck"), F.col("score"), "names", "c_dir", "c_year")
    found = best(mine.select("names", "dir").distinct().join(found, "names"), F.col("score") + by_director, "names", "dir", "c_year")
    found = _null_safe(mine.select("names", "dir", "year").distinct(), found, ["names", "dir"])
    found = best(found.withColumn("score", F.col("score") + by_year).where(F.col("score") >= w["least"]), F.col("score"), "names", "dir", "year")
    out = _null_safe(mine.select("row_id", "names", "dir", "year"), found, ["names", "dir", "year"]).select("row_id", "score", "cand_id")
    if ids:
        worth = lambda x: of_kind(x["vk"] == F.col("ck"), _strong(x["vk"], F.col("ck")), x["rank"])
        met = F.filter("names", lambda x: (x["vk"] != "") & (F.col("ck") != "") & (_inside(x["vk"], F.col("ck")) | _inside(F.col("ck"), x["vk"])))
        shared = [F.when(F.col(c) == F.col(f"c_{c}"), w["ids"][i]).otherwise(0) for i, c in enumerate(("imdb", "tmdb"))]
        score = F.coalesce(F.array_max(F.transform(met, worth)), F.lit(0)) + by_year + by_director + shared[0] + shared[1]
        kinds = mine.select("names", *fields).distinct()
        for c in ("imdb", "tmdb"):
            pairs = kinds.join(theirs, F.col(c) == F.col(f"c_{c}")).withColumn("score", score).where(F.col("score") >= w["least"])
            out = out.unionByName(_null_safe(mine, best(pairs, F.col("score"), "names", *fields), ["names", *fields]).select("row_id", "score", "cand_id"))
    return best(out, F.col("score"), "row_id").select("row_id", "cand_id", "score")


def seen_keys(seen: DataFrame) -> DataFrame:
    """Every key under which a user's seen work is found: id and title key, as ``user_id, k``."""
    return seen.select("user_id", F.explode(F.array_compact(F.array(F.concat(F.lit("i:"), F.col("work_id").cast("string")), F.concat(F.lit("t:"), fresh_key(F.col("title")))))).alias("k")).distinct()


def without_seen(cards: DataFrame, seen: DataFrame, how: str = "left_anti") -> DataFrame:
    """Cards of a user that are unseen (or seen, with ``left_semi``) by id and by title key; two equi joins."""
    keys = seen_keys(seen)
    by = lambda prefix, c: keys.where(F.startswith("k", F.lit(prefix))).select(F.col("user_id").alias("u"), F.substring("k", 3, 1 << 20).alias("v")).distinct()
    ids, titles = by("i:", "work_id"), by("t:", "title")
    on_id = (cards["user_id"] == ids["u"]) & (cards["work_id"].cast("string") == ids["v"])
    on_title = (cards["user_id"] == titles["u"]) & (fresh_key(cards["title"]) == titles["v"])
    if how == "left_anti":
        return cards.join(ids, on_id, "left_anti").join(titles, on_title, "left_anti")
    return cards.join(ids, on_id, "left_semi").union(cards.join(titles, on_title, "left_semi")).distinct()


def orphan_ids(referenced: DataFrame, works: DataFrame) -> DataFrame:
    """Referenced ids that are legacy ids, and legacy ids that shadow a current one: ``id, problem``."""
    legacy = works.select(F.explode("legacy_ids").alias("id")).distinct()
    used = referenced.select(F.col("ref").alias("id")).distinct().join(legacy, "id", "left_semi").withColumn("problem", F.lit("legacy_used"))
    return used.union(legacy.join(works.select("id"), "id", "left_semi").withColumn("problem", F.lit("legacy_shadows")))


def placements(wanted: DataFrame, pool: DataFrame) -> DataFrame:
    """Titles or slots with their pool positions: two equi joins, united and distinct."""
    by_title = wanted.join(pool, F.col("title_key") == F.col("p_title_key")).select("want_id", "pool_id", "pool_pos")
    by_slot = wanted.join(pool, (F.col("channel") == F.col("p_channel")) & (F.col("start_min") == F.col("p_start"))).select("want_id", "pool_id", "pool_pos")
    return by_title.union(by_slot).distinct()


def merge_review_notes(reviews: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes joined to reviews by page and compact title where exactly one of each meets; and the unused notes."""
    key = ["page", "compact"]
    n_r, n_n = (F.count("*").over(Window.partitionBy(*key)).alias(x) for x in ("n_r", "n_n"))
    one_r, one_n = reviews.select("*", n_r).where("n_r = 1").drop("n_r"), notes.select("*", n_n).where("n_n = 1").drop("n_n")
    joined = one_r.join(one_n, key)
    return joined, notes.join(joined.select("note_id"), "note_id", "left_anti")


def in_inventory(samples: DataFrame, inventory: DataFrame, pages: DataFrame) -> DataFrame:
    """Samples that the inventory lacks or whose page is unknown: ``problem``."""
    key = ["date", "channel", "start_min", "title_key"]
    lost = samples.join(inventory.select(*key).distinct(), key, "left_anti").withColumn("problem", F.lit("not_in_inventory"))
    return lost.unionByName(samples.join(pages.select("page").distinct(), "page", "left_anti").withColumn("problem", F.lit("unknown_page")))


def schedule_evidence(cands: DataFrame, inventory: DataFrame) -> DataFrame:
    """Days on which a candidate's title, channel and start stand in the schedule; the date only if there is one; role by rank and target. The days are counted before the join."""
    key = ["title_key", "channel", "start_min"]
    days = inventory.groupBy(*key).agg(F.countDistinct("date").alias("n_days"), F.min("date").alias("_d"))
    out = cands.join(days, key, "left").na.fill(0, ["n_days"])
    return out.withColumn("date", F.when(F.col("n_days") == 1, F.col("_d"))).withColumn("role", F.when(F.col("rank") <= F.col("target"), "selected").otherwise("reserve")).drop("_d")


def best_of(lists: DataFrame, works: DataFrame) -> DataFrame:
    """Listed titles in order with their works; missing ones stay (first of equal titles)."""
    index = first_wins(works.select(fresh_key(F.col("title")).alias("_k"), F.col("id").alias("work_id"), "pos"), "_k", "pos").drop("pos")
    return lists.join(index, fresh_key(F.col("title")) == F.col("_k"), "left").drop("_k")


def hydrate(items: DataFrame, works: DataFrame, fields: list[str], maps: list[str], prefer: str = "item") -> DataFrame:
    """Catalogue values fill an item's empty fields (or, with ``prefer='catalogue'``, override them); maps are merged with the same priority."""
    cat = works.select(F.col("id").alias("_id"), *[F.col(f).alias(f"_c_{f}") for f in [*fields, *maps]])
    j = items.join(cat, items["work_id"] == cat["_id"], "left")
    blank = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    for f in fields:
        pair = (blank(F.col(f)), blank(F.col(f"_c_{f}")))
        j = j.withColumn(f, F.coalesce(*(pair if prefer == "item" else pair[::-1])))
    none = F.create_map().cast("map<string,string>")
    for m in maps:
        a, b = F.coalesce(m, none), F.coalesce(f"_c_{m}", none)
        first, second = (a, b) if prefer == "item" else (b, a)
        j = j.withColumn(m, F.map_concat(first, F.map_filter(second, lambda k, _, first=first: ~F.map_contains_key(first, k))))
    return j.drop("_id", *[f"_c_{f}" for f in [*fields, *maps]])
