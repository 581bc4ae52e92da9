"""Token ids in directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level k holds the k-th chunks of
the ids that have one, and a bitmap that tells which of them go on in level
k + 1; a rank directory counts the set bits before every block of 512. The place
of any token's next chunk is thus the rank of its bit, and one token can be read
without decoding any other. Segments of some million tokens are the rows of a
Parquet table, which Spark's committer writes whole or not at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import bpe
from gridloom.llm.common import shared_folder

BLOCK = 512
#: A segment ends with the document that brings it to so many tokens.
SEGMENT_TOKENS = 1 << 19
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def encode_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    """The levels of an id array: chunks, continuation bitmap and rank directory of each."""
    levels, rest = [], np.asarray(ids, np.uint32)
    while len(rest) or not levels:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(_ONES[bits], np.arange(0, len(bits), BLOCK // 8), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        rank = np.concatenate([[0], np.cumsum(blocks)]).astype("<u4")
        levels.append({"chunks": (rest & 0xFF).astype(np.uint8).tobytes(), "bits": bits.tobytes(), "ranks": rank.tobytes()})
        rest = rest[more] >> 8
    return levels


def decode_levels(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids of a segment."""
    ids = np.zeros(0, np.uint32)
    for level in reversed(levels):
        chunks = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(level["bits"], np.uint8), count=len(chunks), bitorder="little").astype(bool)
        chunks[more] |= ids << 8
        ids = chunks
    return ids


def token_at(levels: list[dict[str, bytes]], i: int) -> int:
    """The i-th id of a segment, by ranks alone. An index outside the segment raises IndexError."""
    if not 0 <= i < len(levels[0]["chunks"]):
        raise IndexError(i)
    value, shift = 0, 0
    for level in levels:
        value |= level["chunks"][i] << shift
        bits, shift = level["bits"], shift + 8
        if not bits[i >> 3] >> (i & 7) & 1:
            return value
        block = i // BLOCK
        start = block * (BLOCK // 8)
        before = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little")
        before += int(_ONES[np.frombuffer(bits[start : i >> 3], np.uint8)].sum())
        i = before + bin(bits[i >> 3] & ((1 << (i & 7)) - 1)).count("1")
    raise ValueError("the last level goes on")


_LEVELS = pa.list_(pa.struct([("chunks", pa.binary()), ("bits", pa.binary()), ("ranks", pa.binary())]))


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text (null: empty), append ``end_id``, and write segments in ascending order of the id.

    Null ids come first; rows that share an id follow each other in order of their
    text. An empty table writes a table without rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        which: list[pa.Array] = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def emit() -> pa.RecordBatch:
            keys = pa.concat_arrays(which)
            columns = [
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                pa.array([lengths], pa.list_(pa.int64())), pa.array([encode_levels(np.concatenate(ids))], _LEVELS),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["part", "segment", "n_tokens", "doc_ids", "lengths", "levels"])

        for b in batches:
            for row, text in enumerate(b.column(1).to_pylist()):
                ids.append(np.append(bpe.encode(tokenizer, text), np.uint32(end_id)))
                which.append(b.column(0).slice(row, 1))
                lengths.append(len(ids[-1]))
                held += lengths[-1]
                if held >= SEGMENT_TOKENS:
                    yield emit()
                    number, held, which, lengths, ids = number + 1, 0, [], [], []
        if held:
            yield emit()

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"part int, segment int, n_tokens long, doc_ids array<{kind}>, lengths array<long>, levels array<struct<chunks: binary, bits: binary, ranks: binary>>"
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(segments, schema).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store: ``doc_id, start, n_tokens, ids_crc32``, from the decoded ids.

    ``start`` counts the ids of all documents before it: sums by file part, then by
    segment within a part, so that no single task sorts all segments.
    """
    table = spark.read.parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.orderBy("part")).alias("_part_start"))
    sizes = table.select("part", "segment", F.col("n_tokens").alias("_n"))
    starts = sizes.select("part", "segment", before(Window.partitionBy("part").orderBy("segment")).alias("_start")).join(parts, "part")
    starts = starts.select("part", "segment", (F.col("_start") + F.col("_part_start")).alias("start"))
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                lengths = np.array(b.column("lengths")[k].as_py(), np.int64)
                ids = decode_levels(b.column("levels")[k].as_py()).astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
                keys = b.column("doc_ids")[k].values
                columns = [keys, *(pa.array(b.column(c)[k : k + 1].take(pa.array(np.zeros(len(ends), np.int64)))) for c in ("part", "segment"))]
                columns += [pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "segment", "at", "n_tokens", "ids_crc32"])

    decoded = table.select("part", "segment", "doc_ids", "lengths", "levels").mapInArrow(
        documents, f"doc_id {kind}, part int, segment int, at long, n_tokens long, ids_crc32 long"
    )
    out = decoded.join(starts, ["part", "segment"])
    return out.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_token(spark: SparkSession, path: str, part: int, segment: int, i: int) -> int:
    """One token of one segment, without decoding the rest."""
    row = spark.read.parquet(path).where((F.col("part") == part) & (F.col("segment") == segment)).select("levels").first()
    return token_at([x.asDict() for x in row["levels"]], i)


def store_path(spark: SparkSession, name: str) -> str:
    """A new place for a store in the shared folder."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
