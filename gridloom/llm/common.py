"""What several of the training-text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.staging import Scratch, shared_folder, staged  # noqa: F401

#: Words are runs of other than these bytes, in every operator that splits on white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: A staged table is broadcast up to so many bytes, as stored and read by the columns asked for.
BROADCAST_BYTES = 16 << 20


def stored_bytes(df: DataFrame) -> int:
    """Catalyst's size of a frame: of a staged table the bytes in store, scaled to the columns read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of staged tables, with a broadcast hint if both its bytes and its rows are few; else as it is, for a shuffled join."""
    small = stored_bytes(df) <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if small else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone. ``lower`` does the same on ASCII strings, and faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def words(c: Column) -> Column:
    """The words of a text (null: none), split on ASCII white space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), rf"{SPACE_CLASS}+"), lambda w: w != "")


def fenced(c: Column) -> Column:
    """``c`` itself, marked so that its projection is evaluated once.

    Filters above a projection are pushed through it with its expressions copied into
    them, also into the bodies of lambdas, which then run once per element. A filter is
    not pushed through a projection that has a non-deterministic column.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def components(edges: DataFrame, tmp: Scratch, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table, as ``node, component``.

    ``component`` is the smallest node of the component. Alternating large-star
    and small-star steps shrink the graph to stars; each step is a group-by with
    a partial minimum and a join, staged in ``tmp``, where the step before the last
    is deleted. Nothing but the answer whether all are stars reaches the driver. An empty table gives an empty table; edges with a null
    end or equal ends are ignored.
    """
    cur = tmp.staged(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "edges",
    )

    def stars(t: DataFrame) -> bool:
        """Whether every node points to one root, and no root to another node."""
        ends = t.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))).alias("e"))
        each = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.root").alias("root"))
        return not each.where("up + root > 1").limit(1).count()

    for _ in range(max_rounds):
        if stars(cur):
            break
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), F.least("u", "m").alias("m"))
        # large star: every larger neighbour of a node goes to the smallest one around that node
        large = (
            both.where("v > u").join(low, F.col("u") == F.col("lu"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        # small star: a node and its smaller neighbours go to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "lu")
        nxt = large.join(low2, F.col("u") == F.col("lu"))
        nxt = tmp.staged(
            nxt.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u != v").distinct(),
            "edges",
        )
        tmp.drop(cur)
        cur = nxt
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = tmp.staged(cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
    tmp.drop(cur)
    return out


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it Spark deletes what a query has shuffled once the query ends; else the files stay until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def parts_of(rows: DataFrame, by: Column, parts: int) -> list[DataFrame]:
    """``rows`` in parts by the hash of ``by``."""
    return [rows.where(F.pmod(F.xxhash64(by), F.lit(parts)) == p) for p in range(parts)] if parts > 1 else [rows]


def in_parts(rows: DataFrame, by: Column, parts: int, each: Callable[[DataFrame], DataFrame], tmp: Scratch, name: str) -> DataFrame:
    """``each`` of ``rows`` in parts by the hash of ``by``, staged one after the other, so that only a part is on its way at a time. Groups that ``each`` makes must lie within ``by``."""
    return tmp.together([tmp.staged(each(part), name) for part in parts_of(rows, by, parts)])


class Links:
    """Verified links among nodes, and the components that they form so far.

    ``verify`` takes pairs ``a, b`` (a < b) and returns them with whether they are a
    ``link``, and with any further measures. It is given ``part`` pairs or so at a time, or all.
    """

    def __init__(self, tmp: Scratch, verify: Callable[[DataFrame], DataFrame], part: int | None = None) -> None:
        self.tmp, self.verify, self.components, self.measures, self.part = tmp, verify, None, [], part

    def labelled(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``comp``, the component of ``node``; a node without links is its own."""
        if self.components is None:
            return rows.withColumn("comp", F.col("node"))
        mine = self.components.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        joined = rows.join(mine, F.col("node") == F.col("_node"), "left")
        return joined.withColumn("comp", F.coalesce("_component", "node")).drop("_node", "_component")

    def take(self, pairs: DataFrame) -> bool:
        """Verify the pairs ``a, b`` that haven't been, and take their links in; whether there were any links."""
        pairs = pairs.distinct()
        for known in self.measures:
            pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        pairs = self.tmp.staged(pairs, "pairs")
        count = pairs.count()
        if not count:
            return False
        found = in_parts(pairs, F.col("a"), -(-count // (self.part or count)), self.verify, self.tmp, "measures")
        self.tmp.drop(pairs)
        self.measures.append(found)
        new = found.where("link").select("a", "b")
        if not new.count():
            return False
        before = self.components
        edges = new if before is None else new.union(before.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.components = components(edges, self.tmp)
        self.tmp.drop(before)
        return True


def hold_against_pivots(rows: DataFrame, links: Links, order: list[Column], fits: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None, parts: int = 1) -> DataFrame:
    """Rounds in which the nodes of each bucket are held against one of them; the first round's pivots.

    ``rows`` has ``key, node`` and what ``order`` and ``fits`` read. A bucket of k nodes
    gives k - 1 pairs a round, never all of its pairs. The first pivot is the least by
    ``order``; the later ones are the least outside its component, so that a bucket of
    several groups links each of them to a pivot of its own. Rounds go on until one
    brings no new link. ``fits``, given accessors of the columns of a node and of the
    pivot, rules out pairs that can't be linked. Hot buckets meet in a join, which is
    split where it is skewed, and in group-bys with partial minimums. The pivots come
    as ``key``, and ``p_`` with the columns of ``rows``. Nodes alike that are both unlike
    every pivot stay apart until `hold_the_rest`, or bounds as in ``near_dedup``, settle them.
    A round takes the buckets in ``parts``.
    """
    columns = [c for c in rows.columns if c != "key"]
    all_rows, pivots, key, tmp = rows, None, F.col("key"), links.tmp
    first = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *columns, "comp")).alias("p")

    def heads_of(part: DataFrame) -> DataFrame:
        cur = links.labelled(part)
        found = cur.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), first).where("_lo <> _hi")
        if pivots is not None:
            outside = cur.join(found.select("key", F.col("p.comp").alias("_main")), "key").where("comp <> _main")
            found = outside.groupBy("key").agg(first)
        return found.select("key", *[F.col(f"p.{c}").alias(f"p_{c}") for c in (*columns, "comp")])

    while True:
        if pivots is not None:  # buckets whose nodes have come together are done
            before, rows = rows, in_parts(rows, key, parts, lambda part: still_open(part, links).drop("comp"), tmp, "open")
            if before is not all_rows:
                tmp.drop(before)
        heads = in_parts(rows, key, parts, heads_of, tmp, "pivots")

        def met(part: DataFrame, heads: DataFrame = heads) -> DataFrame:
            out = links.labelled(part).join(heads, "key").where("comp <> p_comp")
            if fits:
                out = out.where(fits(F.col, lambda c: F.col(f"p_{c}")))
            return out.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b"))

        more = links.take(met(rows)) if parts == 1 else links.take(in_parts(rows, key, parts, lambda part: met(part).distinct(), tmp, "met"))
        if pivots is None:
            pivots = heads
        else:
            links.tmp.drop(heads)
        if not more:
            return pivots


def hold_the_rest(rows: DataFrame, links: Links, fits: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], parts: int = 1) -> None:
    """Compare all nodes of a bucket that are still in several components, pair by pair where ``fits`` allows a link.

    After it no two nodes of a bucket are alike and apart. Buckets of nodes that are alike
    have been settled by pivots; of unlike ones the pairs grow with the square of the bucket. Buckets are taken in ``parts``.
    """
    left = in_parts(rows, F.col("key"), parts, lambda part: still_open(part, links), links.tmp, "open")

    def met(part: DataFrame) -> DataFrame:
        right = part.select("key", *[F.col(c).alias(f"y_{c}") for c in part.columns if c != "key"])
        out = part.join(right, "key").where((F.col("node") < F.col("y_node")) & (F.col("comp") != F.col("y_comp")) & fits(F.col, lambda c: F.col(f"y_{c}")))
        return out.select(F.col("node").alias("a"), F.col("y_node").alias("b"))

    links.take(met(left) if parts == 1 else in_parts(left, F.col("key"), parts, lambda part: met(part).distinct(), links.tmp, "met"))
    links.tmp.drop(left)


def still_open(rows: DataFrame, links: Links, key: str = "key") -> DataFrame:
    """The rows, with ``comp``, of the buckets whose nodes are still in several components."""
    cur = links.labelled(rows)
    several = cur.groupBy(key).agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select(key)
    return cur.join(several, key)
