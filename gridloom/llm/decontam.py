"""Benchmark decontamination with a distributed positional inverted index.

The index holds postings (term, document, position) of the training words that
test windows are anchored at. Anchors are the rarest terms of each window by
their frequency in the whole corpus. Lists are intersected by offset: postings of
an item's anchors that agree on document and offset meet in one group. What is
left is compared word by word, so matches are exact. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, ascii_lower, hinted, staged

WINDOW, ANCHORS = 10, 3
#: Test terms, anchors and candidates are broadcast up to so many rows, joined with a shuffle beyond.
BROADCAST_ROWS = 500_000
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """The words of a text with A-Z as they are."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BREAK), lambda w: w != "")


def _corpus(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``d, h, w``: id, hash of the text (for rows that share an id), words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("d"), F.xxhash64(text).alias("h"), _words(F.col(text_col)).alias("w"))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``k, item, t``: a key for each distinct item and text, its id as text, its words in lower case. Items without words are left out."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), ascii_lower(F.array_join(_words(F.col(text_col)), " ")).alias("s")).where("s <> ''").distinct()
    return rows.select(F.xxhash64(F.coalesce("item", F.lit("")), F.col("item").isNull(), "s").alias("k"), "item", F.split("s", " ").alias("t"))


def _anchors(items: DataFrame, counts: DataFrame, window: int, most: int) -> DataFrame:
    """``k, at, term, need``: the rarest words of each window of an item, each place once; need of them must agree."""
    length = F.least(F.size("t"), F.lit(window))
    places = items.select("k", "t", length.alias("n"), F.explode(F.sequence(F.lit(0), F.size("t") - length)).alias("s"))
    places = places.select("k", "s", "n", F.posexplode(F.slice("t", F.col("s") + 1, F.col("n"))).alias("o", "term"))
    known = places.join(counts, "term", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rarest = Window.partitionBy("k", "s").orderBy("c", "term", "o")
    chosen = known.withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= most)
    return chosen.select("k", (F.col("s") + F.col("o")).alias("at"), "term", F.least("n", F.lit(most)).alias("need")).distinct()


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: ``term, d, h, p`` for each place p (from 0) of each of the terms in each whole text."""
    return _postings(_corpus(docs, id_col, text_col), terms)


def _postings(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    each = corpus.select("d", "h", F.posexplode("w").alias("p", "x")).select("d", "h", "p", ascii_lower(F.col("x")).alias("term"))
    return each.join(hinted(terms, BROADCAST_ROWS), "term")


def _test_index(docs: DataFrame, benchmark: DataFrame, tmp: Scratch, window: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Corpus, items, anchors and the stored postings of the anchors' terms."""
    corpus = _corpus(docs, id_col, text_col)
    items = tmp.staged(_items(benchmark, item_col, item_text_col), "items")
    terms = tmp.staged(items.select(F.explode("t").alias("term")).distinct(), "terms")
    words = corpus.select(F.explode("w").alias("x")).select(ascii_lower(F.col("x")).alias("term"))
    counts = words.join(hinted(terms, BROADCAST_ROWS), "term").groupBy("term").agg(F.count("*").alias("c"))
    anchors = tmp.staged(_anchors(items, counts, window, ANCHORS), "anchors")
    index = tmp.staged(_postings(corpus, tmp.staged(anchors.select("term").distinct(), "anchor-terms")), "postings")
    return corpus, items, anchors, index


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every exact occurrence of a window of an item in a text: ``d, h, item, start, n``.

    A window is ``window`` consecutive words of an item, or all words of a shorter
    one. ``start`` counts words from 0; ``h`` is the hash of the document's text.
    Null and empty texts have no words and no matches, on either side.
    """
    with Scratch(docs.sparkSession, "decontamination") as tmp:
        corpus, items, anchors, index = _test_index(docs, benchmark, tmp, window, id_col, text_col, item_col, item_text_col)
        # lists adjusted by offset: anchors of an item that agree on where it would begin
        met = index.join(hinted(anchors, BROADCAST_ROWS), "term").groupBy("d", "h", "k", (F.col("p") - F.col("at")).alias("z"))
        found = met.agg(F.count("*").alias("c"), F.min("need").alias("need")).where("c >= need").select("d", "h", "k", "z")
        found = tmp.staged(found, "candidates")
        near = tmp.staged(found.join(hinted(items, BROADCAST_ROWS), "k").withColumnRenamed("d", "_d").withColumnRenamed("h", "_h"), "near")
        texts = corpus.join(hinted(near, BROADCAST_ROWS), F.col("d").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")))
        n = F.least(F.size("t"), F.lit(window))
        # the words under the item, blanks where it sticks out; then each window that agrees whole
        under = F.transform(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.coalesce(F.when(F.col("z") + i >= 0, F.get("w", F.col("z") + i)), F.lit("")))
        laid = texts.select("d", "h", "item", "z", "t", n.alias("n"), F.split(ascii_lower(F.array_join(under, " ")), " ").alias("u"))
        starts = F.filter(F.sequence(F.lit(0), F.size("t") - F.col("n")), lambda s: F.slice("t", s + 1, F.col("n")) == F.slice("u", s + 1, F.col("n")))
        out = laid.select("d", "h", "item", "n", "z", F.explode(starts).alias("s")).select("d", "h", "item", (F.col("s") + F.col("z")).alias("start"), "n")
        return staged(out, "matches")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Documents in which as many of an item's rarest terms as a window needs stand within ``slop`` words, in any order: ``d, h, item, start, n_terms``."""
    with Scratch(docs.sparkSession, "decontamination") as tmp:
        _, items, anchors, index = _test_index(docs, benchmark, tmp, window, id_col, text_col, item_col, item_text_col)
        near = index.join(hinted(tmp.staged(anchors.select("k", "term", "need").distinct(), "needs"), BROADCAST_ROWS), "term")
        ahead = Window.partitionBy("d", "h", "k").orderBy("p").rangeBetween(0, slop - 1)
        met = near.withColumn("n_terms", F.size(F.collect_set("term").over(ahead))).where("n_terms >= need")
        best = met.groupBy("d", "h", "k").agg(F.min("p").alias("start"), F.max("n_terms").alias("n_terms"))
        return staged(best.join(hinted(items.select("k", "item"), BROADCAST_ROWS), "k").select("d", "h", "item", "start", "n_terms"), "near-matches")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, h, n_words, n_hit, n_items, items_sha256, contaminated`` of each row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of any window: intervals are
    merged in order, whatever their number. Items with a null id count as one item
    with an empty name. Rows that share id and text get equal results; null ids are
    matched by text as well; empty tables give no hits or no rows. Of ``docs`` only
    id and text are read.
    """
    found = phrase_matches(docs, benchmark, window, id_col, text_col, item_col, item_text_col)
    spans = found.select("d", "h", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    before = Window.partitionBy("d", "h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    hit = spans.withColumn("f", fresh).groupBy("d", "h").agg(F.sum("f").alias("n_hit"))
    named = found.select("d", "h", F.coalesce("item", F.lit("")).alias("item")).distinct().groupBy("d", "h").agg(F.array_sort(F.collect_list("item")).alias("items"))
    per = named.join(hit.withColumnRenamed("d", "_d").withColumnRenamed("h", "_h"), F.col("d").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))).select(F.col("d").alias("_d"), F.col("h").alias("_h"), "items", "n_hit")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.size(_words(F.col(text_col))).cast("long").alias("n_words"))
    out = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "h", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(items, ","), "UTF-8"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
