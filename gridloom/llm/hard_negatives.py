"""Hard negatives of anchor vectors, by exact integer scores from Strassen products of tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, staged

#: A block of candidates has so many rows and stored bytes at most; so many blocks meet a tile of anchors in one group.
BLOCK_ROWS, BLOCK_BYTES, GROUP_BLOCKS = 4096, 1 << 20, 8
#: Anchors are dealt by hash to tiles of about so many.
TILE_ANCHORS = 512
#: Strassen's recursion ends where a side is no longer than this.
LEAF = 32
_LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices by seven half-size products; odd sides are padded with a zero row or column.

    Sums that pass 2**63 on the way wrap around and wrap back, so a product whose values
    fit 64 bits is exact.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return np.ascontiguousarray(a) @ np.ascontiguousarray(b)
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    c = np.empty((2 * h, 2 * j), np.int64)
    p = strassen(a11 + a22, b11 + b22, leaf)
    c[:h, :j] = p
    c[h:, j:] = p
    p = strassen(a21 + a22, b11, leaf)
    c[h:, :j] = p
    c[h:, j:] -= p
    p = strassen(a11, b12 - b22, leaf)
    c[:h, j:] = p
    c[h:, j:] += p
    p = strassen(a22, b21 - b11, leaf)
    c[:h, :j] += p
    c[h:, :j] += p
    p = strassen(a11 + a12, b22, leaf)
    c[:h, :j] -= p
    c[:h, j:] += p
    c[h:, j:] += strassen(a21 - a11, b11 + b12, leaf)
    c[:h, :j] += strassen(a12 - a22, b21 + b22, leaf)
    return c[:m, :n]


def _usable(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, labels and scaled vectors of the rows that take part."""
    ids, labels, vectors = batch.column("id"), batch.column("label"), batch.column("vector")
    keep = [i for i, ok in enumerate(pa.compute.and_(pa.compute.and_(ids.is_valid(), labels.is_valid()), vectors.is_valid()).to_pylist()) if ok]
    if not keep:
        return np.empty(0, np.int64), np.empty(0, np.int64), []
    ids, labels, vectors = ids.take(keep), labels.take(keep), vectors.take(keep)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    ends = np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy())]).astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = np.flatnonzero(bad[ends[1:]] == bad[ends[:-1]])
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(scale * np.where(np.isfinite(flat), flat, 0.0))
    for i in good:
        if np.abs(scaled[ends[i] : ends[i + 1]]).max(initial=0) >= 2**53:
            raise ValueError(f"a component of vector {ids[i]} is beyond 2**53 once scaled")
    ids, labels = ids.to_numpy(zero_copy_only=False).astype(np.int64), labels.to_numpy(zero_copy_only=False).astype(np.int64)
    return ids[good], labels[good], [scaled[ends[i] : ends[i + 1]].astype(np.int64) for i in good]


def candidate_blocks(rows: DataFrame, scale: int) -> DataFrame:
    """``rows`` (``id, label, vector``) packed: ``part, block, ids, labels, width, vectors``, each block sorted by id.

    A row is known by its block and place from here on. Shorter vectors are padded with zeros.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        part, seq, held, held_bytes = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pd.DataFrame:
            held.sort(key=lambda r: r[0])
            width = max(len(v) for _, _, v in held)
            m = np.zeros((len(held), width), np.int64)
            for i, (_, _, v) in enumerate(held):
                m[i, : len(v)] = v
            return pd.DataFrame({"part": [(part << 24) + seq // GROUP_BLOCKS], "block": [(part << 24) + seq], "ids": [np.array([r[0] for r in held], np.int64).tobytes()], "labels": [np.array([r[1] for r in held], np.int64).tobytes()], "width": [width], "vectors": [_packed(m)]})

        for b in batches:
            for r in zip(*_usable(b, scale), strict=True):
                if held and (len(held) == BLOCK_ROWS or held_bytes + 8 * len(r[2]) > BLOCK_BYTES):
                    yield block()
                    seq, held, held_bytes = seq + 1, [], 0
                held.append(r)
                held_bytes += 8 * len(r[2])
        if held:
            yield block()

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in pack(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("vectors", pa.binary())])
    return rows.mapInArrow(arrow, "part long, block long, ids binary, labels binary, width int, vectors binary")


def _packed(m: np.ndarray) -> bytes:
    """A width of 2, 4 or 8 bytes, whichever holds all values, and the values."""
    most = int(np.abs(m).max(initial=0))
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
    return kind[-1].encode() + m.astype(kind).tobytes()


def _matrix(packed: bytes, width: int) -> np.ndarray:
    flat = np.frombuffer(packed, f"<i{packed[:1].decode()}", offset=1).astype(np.int64)
    return flat.reshape(-1, width) if width else np.zeros((0, 0), np.int64)


def _anchors(blocks: DataFrame, every: int) -> DataFrame:
    """The rows of the blocks whose id is divisible by ``every``: ``row, id, label, width, vector``."""

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                ids, labels = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64)
                at = np.flatnonzero(ids % every == 0)
                m = _matrix(r.vectors, r.width) if r.width else np.zeros((len(ids), 0), np.int64)
                yield pd.DataFrame({"row": (r.block << 16) + at, "id": ids[at], "label": labels[at], "width": r.width, "vector": [_packed(m[i]) for i in at]})

    return blocks.mapInPandas(pick, "row long, id long, label long, width int, vector binary")


def _scores(anchors: pd.DataFrame, block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of a tile with ids, labels and row numbers of its candidates."""
    ids, labels = np.frombuffer(block.ids, np.int64), np.frombuffer(block.labels, np.int64)
    width = max(int(anchors["width"].max()), block.width)
    a = np.zeros((len(anchors), width), np.int64)
    for i, (v, w) in enumerate(zip(anchors["vector"], anchors["width"], strict=True)):
        if w:
            a[i, :w] = _matrix(v, w)[0]
    b = np.zeros((width, len(ids)), np.int64)
    if block.width:
        b[: block.width] = _matrix(block.vectors, block.width).T
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * width >= 2**63:
        raise ValueError("scores of these vectors don't fit 64 bits")
    return strassen(a, b), ids, labels, (block.block << 16) + np.arange(len(ids))


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, in order; of equal ones the earlier."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")[:k]]


class Heaps:
    """The ``k`` best rows per key, from tile after tile; merged with those of other tasks later."""

    def __init__(self, k: int) -> None:
        self.k, self.best = k, {}

    def add(self, key: tuple, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            at = _first(scores, self.k)
            both = self.best.get(key, []) + list(zip((-scores[at]).tolist(), ids[at].tolist(), strict=True))
            self.best[key] = sorted(both)[: self.k]


def _tiles(anchors: DataFrame, blocks: DataFrame, n_tiles: int, found, schema: str) -> DataFrame:
    """``found(anchors, blocks)`` of every tile of anchors and part of the blocks: groups of a bounded size on both sides."""
    tiles = F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1)))
    parts = blocks.select(F.col("part").alias("meets")).distinct().select("meets", tiles.alias("_tile"))
    left = anchors.join(parts, F.col("tile") == F.col("_tile")).drop("_tile")
    right = blocks.withColumn("tile", tiles)
    return left.groupBy("tile", "meets").cogroup(right.groupBy("tile", "part")).applyInPandas(found, schema)


def mine(
    embeddings: DataFrame, *, anchor_every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, label: Column | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Hard negatives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``anchor_every``. An anchor's positives
    are its best ``positives`` other rows of its label; the negatives of a pair are the
    best ``negatives`` rows of another label with a score of ``low`` to ``high`` per cent
    of the pair's. A score is the inner product of the vectors, each component times
    ``scale`` and rounded down; a shorter vector counts as padded with zeros. Equal scores
    go by id. ``label`` may stand for the column of that name.

    Rows with a null id, label, vector or component, or a component that isn't finite,
    take no part. Repeated rows are rows of their own: a copy of the anchor may be its
    positive, and each copy of an anchor gives rows. An empty table, or one without
    anchors, gives an empty table. Vectors whose scores might pass 64 bits raise an error.

    Two passes multiply tiles of anchors with blocks of candidates. The first keeps a heap
    of positives per anchor, the second one of negatives per window; heaps of different
    blocks are merged by the shuffle. No scores are stored.
    """
    spark = embeddings.sparkSession
    with Scratch(spark, "negatives") as tmp:
        rows = embeddings.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).cast("long").alias("label"), F.col(vector_col).alias("vector"))
        blocks = tmp.staged(candidate_blocks(rows, scale), "blocks")
        anchors = tmp.staged(_anchors(blocks, anchor_every), "anchors")
        n_tiles = max(1, -(-anchors.count() // TILE_ANCHORS))
        anchors = anchors.withColumn("tile", F.pmod(F.xxhash64("row"), F.lit(n_tiles)).cast("int"))

        def best_positives(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            heaps = Heaps(positives)
            for block in b.itertuples(index=False) if len(a) else ():
                scores, ids, labels, at = _scores(a, block)
                for i, r in enumerate(a.itertuples(index=False)):
                    ok = np.flatnonzero((labels == r.label) & (at != r.row))
                    heaps.add((r.row, r.id), scores[i, ok], ids[ok])
            return pd.DataFrame([(*k, i, -s) for k, best in heaps.best.items() for s, i in best], columns=["row", "anchor_id", "positive_id", "positive_score"])

        found = _tiles(anchors, blocks, n_tiles, best_positives, "row long, anchor_id long, positive_id long, positive_score long")
        ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")))
        best = tmp.staged(ranked.where(F.col("_r") <= positives).drop("_r"), "positives")
        wanted = anchors.join(best.groupBy("row").agg(F.collect_set("positive_score").alias("windows")), "row")

        def best_negatives(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            heaps = Heaps(negatives)
            for block in b.itertuples(index=False) if len(a) else ():
                scores, ids, labels, _ = _scores(a, block)
                for i, r in enumerate(a.itertuples(index=False)):
                    other = np.flatnonzero(labels != r.label)
                    mine = scores[i, other]
                    for w in map(int, r.windows):
                        # low * w <= 100 * score <= high * w, rounded inwards
                        ok = np.flatnonzero((mine >= -(-low * w // 100)) & (mine <= high * w // 100))
                        heaps.add((r.row, w), mine[ok], ids[other[ok]])
            return pd.DataFrame([(*k, i, -s) for k, best in heaps.best.items() for s, i in best], columns=["row", "positive_score", "negative_id", "negative_score"])

        hard = _tiles(wanted, blocks, n_tiles, best_negatives, "row long, positive_score long, negative_id long, negative_score long")
        order = Window.partitionBy("row", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
        hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        out = best.join(hard, ["row", "positive_score"])
        return staged(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
