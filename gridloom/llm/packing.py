"""Pattern packing of token sequences by non-negative least squares.

The work that grows with the corpus stays in Spark: tokenizing, the histogram of
piece lengths (at most ``capacity`` rows), the rank of each piece among those of
its length, and the offsets. The driver sees the histogram alone. It enumerates
patterns of up to three length classes that fill a sequence, fits how often each
is used to the histogram by non-negative least squares, rounds, and packs what
is left best-fit decreasing on the histogram. The plan is a table of runs over
the pieces in order of length, whose size depends on ``capacity`` only.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import bpe
from gridloom.llm.common import staged

#: Pieces of one length are ranked in buckets of about so many, in at most so many buckets.
BUCKET_ROWS, BUCKETS = 256, 4096
PIECE_COLUMNS = "piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: ids of the text, then ``end_id``, cut only if longer than ``capacity``.

    Of a cut document the first piece is the shorter one, so that each other piece
    fills a sequence. A null or empty text is one piece of the end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(bpe.encode(tokenizer, text), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for k, (lo, hi) in enumerate(zip([0, *range(first, len(ids), capacity)], [*range(first, len(ids) + 1, capacity)], strict=True)):
                    which.append(row), piece.append(k), start.append(lo), length.append(hi - lo)
                    crc.append(zlib.crc32(ids[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(cut, f"`{id_col}` {kind}, {PIECE_COLUMNS}")


def nnls(rows: np.ndarray, target: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Active-set non-negative least squares for a matrix whose columns are sums of unit vectors.

    ``rows`` has a line for each column of the matrix and names its (up to three)
    rows, -1 for none. Columns enter by steepest gradient and leave when they
    would turn negative; at most ``rounds`` (three times the rows) columns enter.
    """
    n, m = len(target), len(rows)
    dense = np.zeros((n + 1, m))
    for k in range(rows.shape[1]):
        np.add.at(dense, (rows[:, k], np.arange(m)), 1.0)
    dense = dense[:n]
    x, active, gram = np.zeros(m), np.zeros(m, bool), dense.T @ target
    for _ in range(rounds or 3 * n):
        slope = gram - dense.T @ (dense[:, active] @ x[active])
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-6 * max(1.0, float(target.max(initial=0.0))):
            break
        active[best] = True
        while True:
            on = np.flatnonzero(active)
            a = dense[:, on]
            z = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(on)), gram[on])
            if z.min(initial=1.0) > 0:
                break
            low = z <= 0
            step = (x[on][low] / np.maximum(x[on][low] - z[low], 1e-300)).min()
            x[on] += step * (z - x[on])
            gone = on[(x[on] <= 1e-9) & low]
            gone = gone if len(gone) else on[[int(z.argmin())]]
            x[gone], active[gone] = 0.0, False
        x[on] = z
    return x


@dataclass
class Plan:
    """Runs over the pieces in order of (length, rank): piece ``start + i`` goes to sequence ``base + i // per``, as its slot ``slot + i % per``."""

    start: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    base: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    slot: list[int] = field(default_factory=list)
    sequences: int = 0

    def add(self, start: int, count: int, base: int, per: int, slot: int) -> None:
        self.start.append(start), self.count.append(count), self.base.append(base), self.per.append(per), self.slot.append(slot)


def plan(histogram: dict[int, int], capacity: int, classes: int = 512) -> Plan:
    """The packing plan of a histogram of lengths from 1 to ``capacity``. An empty histogram gives an empty plan."""
    out = Plan()
    lengths = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        lengths[length] = n
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])  # ordinal of the first piece of each length
    used = np.zeros(capacity + 1, np.int64)

    # patterns over classes of about equal width; a class stands for its longest length
    width = max(1, -(-capacity // classes))
    top = capacity // width
    by_class = np.zeros(top + 1, np.int64)
    np.add.at(by_class, -(-np.arange(1, top * width + 1) // width), lengths[1 : top * width + 1])
    have = np.flatnonzero(by_class)
    patterns = [(top, -1, -1)] if by_class[top] else []
    patterns += [(a, top - a, -1) for a in have if a <= top - a and by_class[top - a]]
    patterns += [(a, b, top - a - b) for a in have for b in have if a <= b <= top - a - b and by_class[top - a - b]]
    if patterns:
        rows = np.array(patterns) - 1
        rows[rows < 0] = -1
        times = nnls(rows, by_class[1:].astype(float))
        left = by_class.copy()
        at = np.array([first[c * width - width + 1] if c else 0 for c in range(top + 1)])  # classes hold consecutive ordinals
        for k in np.argsort(-times, kind="stable"):
            need = {int(c): patterns[k].count(c) for c in patterns[k] if c > 0}
            n = min(int(times[k] + 0.5), *(int(left[c]) // q for c, q in need.items()))
            if n <= 0:
                continue
            for slot, c in enumerate(c for c in patterns[k] if c > 0):
                out.add(int(at[c]), n, out.sequences, 1, slot)
                at[c] += n
                left[c] -= n
            out.sequences += n
        for c in range(1, top + 1):
            taken = int(by_class[c] - left[c])
            for length in range((c - 1) * width + 1, c * width + 1):
                used[length] = min(taken, int(lengths[length]))
                taken -= int(used[length])

    # best fit, longest first, on counts: bins of equal room that follow each other are one entry
    rooms: list[int] = []
    bins: dict[int, list[tuple[int, int, int]]] = {}  # by room: first sequence, how many, slots taken

    def put(room: int, entry: tuple[int, int, int]) -> None:
        if room and entry[1]:
            if room not in bins:
                insort(rooms, room)
            bins.setdefault(room, []).append(entry)

    for length in range(capacity, 0, -1):
        n, at_piece = int(lengths[length] - used[length]), int(first[length] + used[length])
        while n:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                base, m, slots = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[k]
            else:
                room, base, m, slots = capacity, out.sequences, -(-n // (capacity // length)), 0
                out.sequences += m
            per = room // length
            full = min(m, n // per)
            if full:
                out.add(at_piece, full * per, base, per, slots)
                put(room - per * length, (base, full, slots + per))
                n, at_piece = n - full * per, at_piece + full * per
                put(room, (base + full, m - full, slots)) if full < m else None
            else:
                out.add(at_piece, n, base, n, slots)
                put(room - n * length, (base, 1, slots + n))
                put(room, (base + 1, m - 1, slots))
                n = 0
    return out


def pack(pieces: DataFrame, capacity: int, keys: list[str]) -> DataFrame:
    """Pack rows with a ``length`` from 1 to ``capacity``: adds ``sequence_id`` and ``offset`` to each.

    ``keys`` identify a piece; rows equal in all keys are equal pieces and
    interchangeable. Sequences are numbered from 0 and filled from offset 0
    without gaps. A length that a third of all pieces share is ranked in up to
    `BUCKETS` buckets. Rows without a length or with one beyond the capacity
    raise an error.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if any(x is None or not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    runs = plan(histogram, capacity)
    order = np.argsort(np.array(runs.start, np.int64), kind="stable")
    start, base, per, slot = (np.array(x, np.int64)[order] for x in (runs.start, runs.base, runs.per, runs.slot))

    at, known = 0, []
    for length in sorted(histogram):
        known.append((length, at, min(BUCKETS, 1 + histogram[length] // BUCKET_ROWS)))
        at += histogram[length]
    lengths = spark.createDataFrame(known, "length long, _first long, _buckets int")
    dealt = pieces.join(F.broadcast(lengths), "length").withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.col("_buckets")))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy(*keys)
    ranked = dealt.withColumn("_rank", F.row_number().over(within)).join(sums, ["length", "_bucket"])
    ranked = ranked.withColumn("_ordinal", F.col("_first") + F.col("_before") + F.col("_rank") - 1).select(*pieces.columns, "_ordinal")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ordinal = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            k = np.searchsorted(start, ordinal, side="right") - 1
            i = ordinal - start[k]
            columns = [*b.columns[:-1], pa.array(base[k] + i // per[k], pa.int64()), pa.array(slot[k] + i % per[k], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "sequence_id", "_slot"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    out = ranked.mapInArrow(placed, f"{fields}, sequence_id long, _slot long")
    here = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(here), F.lit(0))).drop("_slot")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize and pack every document: a row for each piece, with its place.

    Null and empty texts are one piece of the end id. Repeated rows are packed as
    often as they occur, null ids stay null, an empty table gives no sequence,
    and other columns are not read. Texts are encoded once: the pieces (ids'
    digests and lengths) are staged.
    """
    pieces = staged(pieces_of(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    return pack(pieces, capacity, [id_col, "piece", "start", "ids_crc32"])
