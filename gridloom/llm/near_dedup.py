"""Near-duplicate documents by circulant MinHash, with exact confirmation.

One permutation scatters the shingle hashes over 32 bits; a second one, circularly
shifted by k, gives the k-th coordinate of the signature. Bands of coordinates
bring candidates together. Texts with equal shingle sets are one class from the
start, and only one of each class enters the bands, so copies are never expanded
into pairs. Each candidate link is confirmed on the full shingle sets.

A bucket is not expanded into pairs either. Its sets are held against a pivot, and
what sets differ from their pivot by decides which of them can be linked with one
another at all (`between_pivots`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Links, Scratch, hinted, hold_against_pivots, staged, still_open

#: 20 bands of 4 coordinates: a pair of Jaccard similarity 0.8 meets in none with probability 3e-5, one of 0.9 with less than 1e-9.
BANDS, ROWS = 20, 4
#: Candidate documents are found in the corpus by a broadcast up to so many ids, by a shuffled join beyond.
BROADCAST_IDS = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _permute32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers: xor-shifts and odd multipliers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(a)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(b)
    return x ^ (x >> np.uint32(16))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_set(text: str | None, width: int = 2) -> np.ndarray:
    """The sorted 64-bit hashes of a whole text's distinct word shingles, A-Z lower-cased.

    A text with fewer than ``width`` words, but not none, has its whole sequence as
    its one shingle; a text without words, or null, has none.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    # a word's hash is a difference of prefix sums, moved back to its start
    sums = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)), dtype=np.uint64)])
    word = _mix64((sums[end] - sums[start]) * _powers(_INVERSE, len(raw))[start] + (end - start).astype(np.uint64))
    n = max(1, len(word) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(word))):
        out = _mix64(out * _BASE + word[k : k + n] + np.uint64(k + 1))
    return np.unique(out)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` coordinates of the circulant MinHash of a set that isn't empty."""
    at = _permute32((shingles >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)  # the first permutation
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    shift = np.arange(size, dtype=np.uint32)
    for lo in range(0, len(at), 4096):
        shifted = at[lo : lo + 4096, None] - shift  # circular in 32 bits
        np.minimum(out, _permute32(shifted, 0x21F0AAAD, 0xD35A2D97).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band."""
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in sig.reshape(bands, rows).T.astype(np.uint64):
        out = _mix64(out * _BASE + column)
    return out


def sketches(docs: DataFrame, width: int = 2, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, t, n, h1, h2, bands`` of each whole text: its 64-bit hash, set size, 128-bit digest of the set, band keys (none for an empty set)."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, keys = [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, width)
                n.append(len(s))
                digests.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                keys.append(band_keys(signature(s, bands * rows), bands, rows).view(np.int64) if len(s) else np.zeros(0, np.int64))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            columns = [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([int(d[0]) for d in digests], pa.int64()), pa.array([int(d[1]) for d in digests], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "n", "h1", "h2", "bands"])

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    return hashed.mapInArrow(sketched, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long, n long, h1 long, h2 long, bands array<long>")


def set_table(docs: DataFrame, classes: DataFrame, nodes: DataFrame, tmp: Scratch, width: int = 2) -> DataFrame:
    """``node, s``: the full sets of the ``classes`` in ``nodes`` (``node``), by the text of the row that stands for each, staged."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t, width).view(np.int64) for t in b.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["node", "s"])

    texts = tmp.staged(classes.select("node", "rep", F.col("t").alias("_t")).join(nodes, "node", "left_semi"), "ids")
    wanted = docs.join(hinted(texts, BROADCAST_IDS), (F.col("doc_id") == F.col("rep")) & (F.xxhash64("text") == F.col("_t")))
    rows = wanted.select("node", "text").mapInArrow(sets, "node long, s array<long>")
    return tmp.staged(rows.dropDuplicates(["node"]), "sets")


def confirmed(sets: DataFrame, pairs: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs ``a, b`` of nodes with the size ``m`` of the intersection of their full sets, and ``link``: 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    met = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("m"))
    return met.select("a", "b", "m", (100 * F.col("m") >= percent * (F.col("na") + F.col("nb") - F.col("m"))).alias("link"))


def between_pivots(rows: DataFrame, pivots: DataFrame, links: Links, sets: DataFrame, percent: int) -> None:
    """Find the links among the sets of a bucket that its pivot doesn't bring.

    A set is described by what it differs from the pivot in: ``d`` shingles that only
    one of the two has. Two sets x and y are linked if they differ from each other in
    at most T = (nx + ny) (100 - percent) / (100 + percent) shingles, and they differ in
    what exactly one of their differences has. So either dx + dy <= T, and then they
    are linked for sure, or the differences have shingles in common:

    * The first kind is settled by one set for each pivot, the one of least
      d - n (100 - percent) / (100 + percent): whoever is linked so with any set is
      linked so with this one.
    * For the second kind the shingles of a difference are put in an order, those that
      the pivot lacks first and the rarest among the pivot's sets before others. At most
      T of them stand before the first one in common; of the shorter difference at most
      T / 2, as it has fewer to spare. Sets meet by these shingles alone: first by pivots
      again, then pair by pair, where sizes and places (i - 1) + (j - 1) +
      abs((dx - i) - (dy - j)) <= T allow a link.

    No bound is a guess: no link among sets of a bucket is lost.
    """
    tmp, spare, whole = links.tmp, 100 - percent, 100 + percent
    measured = links.measures[0].select("a", "b", "m")
    members = rows.select("key", "node", "n").join(pivots.select("key", F.col("p_node").alias("p"), F.col("p_n").alias("pn")), "key").select("p", "pn", "node", "n").distinct()
    members = members.withColumn("_a", F.least("node", "p")).withColumn("_b", F.greatest("node", "p"))
    members = members.join(measured.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "m"), ["_a", "_b"], "left")
    d = F.when(F.col("node") == F.col("p"), 0).otherwise(F.col("n") + F.col("pn") - 2 * F.col("m"))
    members = tmp.staged(still_open(members.select("p", "node", "n", d.cast("long").alias("d")), links, "p").drop("comp"), "members")

    # linked for sure with the set of most room
    room = F.col("d") * whole - F.col("n") * spare
    cur = still_open(members, links, "p").withColumn("room", room)
    best = cur.groupBy("p").agg(F.min(F.struct("room", "node", "comp")).alias("best"))
    sure = cur.join(best, "p").where("comp <> best.comp AND room + best.room <= 0")
    links.take(sure.select(F.least("node", "best.node").alias("a"), F.greatest("node", "best.node").alias("b")))

    # differences, shingles that the pivot lacks first
    most = F.floor(F.col("n") * spare / percent).cast("long")
    cur = still_open(members, links, "p")
    both = cur.join(sets.select("node", "s"), "node").join(sets.select(F.col("node").alias("p"), F.col("s").alias("sp")), "p")
    both = both.select("p", "node", "n", "d", "s", "sp", F.array_except("s", "sp").alias("more"))
    less = F.when(F.size("more") <= most, F.array_except("sp", "s")).otherwise(F.array().cast("array<long>"))
    diffs = tmp.staged(both.select("p", "node", "n", "d", "more", less.alias("less")), "differences")
    plain = diffs.select("p", F.explode(F.concat("more", "less")).alias("token"))
    shared = plain.groupBy("p", "token").agg(F.count("*").alias("df")).where("df > 1")
    of_kind = lambda c, k: F.transform(c, lambda t: F.struct(F.lit(k).alias("c"), t.alias("token")))
    each = diffs.select("p", "node", "n", "d", F.size("more").alias("n_more"), F.size("less").alias("n_less"), F.explode(F.concat(of_kind("more", 0), of_kind("less", 1))).alias("e"))
    each = each.select("p", "node", "n", "d", "n_more", "n_less", "e.c", "e.token").join(shared, ["p", "token"])
    # places in the whole difference, though shingles that no other set has are left out
    mine = Window.partitionBy("p", "node")
    each = each.withColumn("r", F.row_number().over(mine.orderBy("c", "df", "token"))).withColumn("s", F.sum(1 - F.col("c")).over(mine)).withColumn("all", F.count("*").over(mine))
    place = F.when(F.col("c") == 0, F.col("n_more") - F.col("s") + F.col("r")).otherwise(F.col("n_more") + F.col("n_less") - F.col("all") + F.col("r"))
    each = each.select(F.struct("p", "token").alias("key"), "node", "n", "d", place.cast("long").alias("i"))
    each = tmp.staged(each.where(F.col("i") <= most + 1), "shared-differences")

    def fits(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
        least = F.least(x("n"), y("n")) * 100 >= F.greatest(x("n"), y("n")) * percent
        unlike = x("i") + y("i") - 2 + F.abs(x("d") - x("i") - y("d") + y("i"))
        return least & (unlike * whole <= (x("n") + y("n")) * spare)

    hold_against_pivots(each, links, [F.col("d"), F.col("node")], fits)
    left = tmp.staged(still_open(each, links), "open-differences")
    right = left.select("key", *[F.col(c).alias(f"y_{c}") for c in left.columns if c != "key"])
    shorter = F.struct("y_d", "y_node") < F.struct("d", "node")
    met = left.join(right.where(F.col("y_i") <= F.floor(F.col("y_n") * spare / percent / 2) + 1), "key")
    met = met.where((F.col("comp") != F.col("y_comp")) & shorter & fits(F.col, lambda c: F.col(f"y_{c}")))
    links.take(met.select(F.least("node", "y_node").alias("a"), F.greatest("node", "y_node").alias("b")))


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row.

    ``component_id`` is the smallest id reachable over links, the row's own included;
    ``kept`` says that it is the row's own. Rows without words have an empty set and
    are linked with nothing. Rows that share an id with equal text get equal results;
    with different texts each row follows its own text. Rows without an id take no part: their ``component_id`` is null
    and they are kept. An empty table gives an empty table; other columns are not read.
    Two different sets of equal 128-bit digest, or shingles of equal 64-bit hash,
    would count as equal.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    all_rows = staged(sketches(docs, width), "sketches")
    with Scratch(docs.sparkSession, "near-dedup") as tmp:
        ends = staged(_components_of_sets(docs, all_rows, tmp, width, percent), "near-dedup-sets")
    labelled = all_rows.select("doc_id", "n", "h1", "h2").join(ends.withColumnRenamed("h1", "_h1").withColumnRenamed("h2", "_h2"), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    label = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), label.alias("component_id"), F.coalesce(label == F.col("doc_id"), F.lit(True)).alias("kept"))


def _components_of_sets(docs: DataFrame, all_rows: DataFrame, tmp: Scratch, width: int, percent: int) -> DataFrame:
    """``h1, h2, c``: the smallest id of the component of each set that has another id than its own."""
    named = all_rows.where("n > 0 AND doc_id IS NOT NULL")
    # one of each class of equal sets, numbered; the partial minimum takes a hot class in before the shuffle
    classes = named.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "t", "n", "bands")).alias("r"), F.max("doc_id").alias("last"))
    classes = tmp.staged(classes.select("h1", "h2", "r.*", "last", F.monotonically_increasing_id().alias("node")).withColumnRenamed("doc_id", "rep"), "classes")
    keys = classes.select(F.explode("bands").alias("key"), "node")
    counts = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = tmp.staged(keys.join(counts, "key"), "buckets")
    # the sets that share most buckets with others are held against first
    sized = shared.groupBy("node").agg(F.sum("c").alias("pop")).join(classes.select("node", "n"), "node")
    sized = tmp.staged(sized, "bucket-nodes")
    rows = tmp.staged(shared.select("key", "node").join(sized, "node"), "buckets")
    tmp.drop(shared)
    sets = set_table(docs, classes, sized.select("node"), tmp, width)
    links = Links(tmp, lambda pairs: confirmed(sets, pairs, percent))
    pivots = hold_against_pivots(rows, links, [-F.col("pop"), F.xxhash64("node"), F.col("node")])
    if links.measures:
        between_pivots(rows, pivots, links, sets, percent)
    ends = links.labelled(classes.select("h1", "h2", "rep", "last", "node"))
    least = ends.groupBy("comp").agg(F.min("rep").alias("c"), F.max("last").alias("_last")).where("c <> _last").withColumnRenamed("comp", "_comp")
    return ends.join(least, F.col("comp") == F.col("_comp")).select("h1", "h2", "c")
