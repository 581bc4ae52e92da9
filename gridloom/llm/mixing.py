"""Mixing sources to target weights: hash-random order within a source, distributed prefix sums, a cut at each budget."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD_PATTERN, Scratch, staged

BEFORE = Window.unboundedPreceding, -1


def running_totals(rows: DataFrame, tmp: Scratch, group: list[str], order: list[str], value: str, per_group: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows of its group that come earlier by ``order``.

    The rows are range-partitioned by group and order, so that a hot group is dealt to
    many partitions; sums of each part of a group give where the part begins, and only a
    part is ever summed row by row. ``per_group`` brings further columns of the groups,
    which ride on the parts. Nulls are a group of their own.
    """
    dealt = tmp.staged(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    parts = dealt.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    parts = parts.withColumn("_start", F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(*BEFORE)), F.lit(0))).drop("_sum")
    if per_group is not None:
        same = [parts[g].eqNullSafe(per_group[g]) for g in group]
        parts = parts.join(per_group, same).select(parts["*"], *[per_group[c] for c in per_group.columns if c not in group])
    same = [dealt[g].eqNullSafe(parts[g]) for g in [*group, "_part"]]
    joined = dealt.join(parts, same).select(dealt["*"], *[parts[c] for c in parts.columns if c not in (*group, "_part")])
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(*BEFORE)
    return joined.withColumn("before", F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_start", "_part")


def random_key(doc_id: Column, seed: int) -> Column:
    """60 bits of the MD5 of seed and id: the same in every run and on every cluster."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def with_targets(sources: DataFrame, tmp: Scratch, weights: Sequence[float] | Mapping[str, float], share: float, epochs: int) -> DataFrame:
    """``source, source_size`` with ``target``: ``share`` of all sizes by weight, at most ``epochs`` times a source's size.

    A sequence of weights repeats over the sources by code point, null last; a mapping
    names them, others weigh nothing. What the limits take from a target is shared anew
    by weight until none is above; each round is one aggregate over the table of sources.
    """
    sources = tmp.staged(sources, "sources")
    if isinstance(weights, Mapping):
        weight = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))) for k, w in weights.items()], F.lit(0.0))
        weighed = sources.withColumn("_weight", weight)
    else:
        placed = running_totals(sources.select("source", F.col("source").isNull().alias("_last"), F.lit(1).alias("_one"), "source_size"), tmp, [], ["_last", "source"], "_one")
        cycle = F.array(*[F.lit(float(w)) for w in weights])
        weighed = placed.select("source", "source_size", F.element_at(cycle, (F.col("before") % len(weights) + 1).cast("int")).alias("_weight"))
    weighed = tmp.staged(weighed.withColumn("_most", F.col("source_size") * float(epochs)), "weighed")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, known = 0.0, None
    while level != known:
        known = level
        above = F.col("_weight") * level > F.col("_most")
        full, free = weighed.agg(F.sum(F.when(above, F.col("_most"))), F.sum(F.when(~above, F.col("_weight")))).first()
        level = max(known, (share * total - (full or 0.0)) / free) if free else known
    return weighed.select("source", "source_size", F.least(F.col("_most"), F.col("_weight") * level).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] | Mapping[str, float] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 11, carry: Sequence[str] = ()) -> DataFrame:
    """Every document with ``size``, its ``source_size``, its source's ``target`` and the words ``taken`` of it, repeats counted.

    The documents of a source stand in the order of a random key; epoch after epoch goes
    through them until the source's budget, its target rounded to whole words, is spent,
    so that a source takes just its budget and a document ``epochs`` times its size at
    most. The last document is cut inside. Needs ``doc_id, text, source``; ``carry``
    names columns that come along (the texts, for `epoch_rows`), else only sizes are
    shuffled. Null text: no words. A null source is a source of its own, the last. Null
    ids and repeated rows take part each by itself; rows equal in source, id and size may
    swap places, which no result shows unless ``carry`` tells them apart. An empty table
    gives an empty table.
    """
    with Scratch(docs.sparkSession, "mix") as tmp:
        size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
        extra = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(0)
        rows = tmp.staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), random_key(F.col("doc_id"), seed).alias("_key"), extra.alias("_row")), "sizes")
        sources = with_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), tmp, weights, share, epochs)
        placed = running_totals(rows, tmp, ["source"], ["_key", "doc_id", "size"], "size", sources)
        budget = F.floor(F.col("target") + 0.5)
        taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("source_size") * e - F.col("before"))) for e in range(epochs)), F.lit(0))
        out = placed.withColumn("taken", taken.cast("long"))
        kept = ["doc_id", "size", "source_size", "target", "taken"]
        return staged(out.select(*kept, "before", "_row") if carry else out.select(*kept), "mixed")


def epoch_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself, of `mix` with ``carry``: a row per document and epoch that takes words of it.

    ``epoch`` counts from 0, ``words`` is what the epoch takes. The columns carried come
    back; in a document that is cut ``text`` becomes its first words, set apart by spaces.
    """
    rows = mixed.where("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    rows = rows.withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("size") * F.col("epoch")))
    names = mixed.schema["_row"].dataType.names
    start = F.array_join(F.slice(F.regexp_extract_all("_row.text", F.lit(WORD_PATTERN), 0), 1, F.col("words").cast("int")), " ") if "text" in names else F.lit(None)
    cut = [F.when(F.col("words") < F.col("size"), start).otherwise(F.col("_row.text")).alias(c) if c == "text" else F.col(f"_row.{c}").alias(c) for c in names if c != "doc_id"]
    return rows.select("doc_id", "epoch", "words", *cut)
