"""Spelling variants: words one edit apart, found by Gram matrices of blocks of letter counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, ascii_lower, staged

#: Letters of words; code points 0xD7 and 0xF7 among them, as the range has them.
LETTERS = "A-Za-zÀ-ÿ"
#: A block has so many words at most, and so many letters unless it is a single word.
BLOCK_WORDS, BLOCK_LETTERS = 256, 4096
#: Letters fall into so many classes by code point; a block holds words with the same number of each.
CLASSES = 6
#: Blocks that meet one block are multiplied with it together, up to so many words.
TILE_WORDS = 8192


def word_counts(docs: DataFrame, least_length: int = 5, least_n: int = 3, drop_one_in: int | None = None) -> DataFrame:
    """``word, n``: the runs of letters of all texts, A-Z lower-cased, by count.

    With ``drop_one_in`` d, a run loses the code point h % length, counted from 0, where
    d divides h, the CRC-32 of ``<doc_id>:<run>``: misspellings to find again. Null text
    has no runs; under a null ``doc_id`` no run loses a letter. An empty table gives no
    words.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), 0)).alias("run"))
    word = ascii_lower(F.col("run"))
    if drop_one_in:
        runs = runs.select("doc_id", word.alias("run"))
        runs = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % drop_one_in == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= least_length) & (F.col("n") >= least_n))


def _class_counts(word: Column) -> Column:
    letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
    of = ["".join(x for x in letters if ord(x) % CLASSES == k) for k in range(CLASSES)]
    return F.array(*[F.length(word) - F.length(F.translate(word, x, "")) for x in of])


def _moved(counts: Column, down: int | None, up: int | None) -> Column:
    """The class counts with one letter less in one class and one more in another."""
    return F.array(*[counts[k] - int(k == down) + int(k == up) for k in range(CLASSES)])


def _blocks(words: DataFrame) -> DataFrame:
    """``cell, block, letters, n``: words with equal class counts, in bounded blocks; ``letters`` strings them together, all being of one length."""
    celled = words.select("word", "n", _class_counts(F.col("word")).alias("cell"))
    sizes = celled.groupBy("cell").agg(F.count("*").alias("size")).withColumnRenamed("cell", "_cell")
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS // 2), F.floor(BLOCK_LETTERS / F.length("word")).cast("int")))
    dealt = celled.join(sizes, F.col("cell") == F.col("_cell")).withColumn("block", F.pmod(F.xxhash64("word"), F.ceil(F.col("size") / room)))
    packed = dealt.groupBy("cell", "block").agg(F.collect_list(F.struct("word", "n")).alias("rows"), F.max(F.length("word")).alias("length"))
    return packed.select("cell", "block", "length", F.array_join("rows.word", "").alias("letters"), F.col("rows.n").alias("n"))


def _codes(letters: str, length: int) -> np.ndarray:
    return np.frombuffer(letters.encode("utf-32-le"), "<u4").reshape(-1, length)


def _counts(codes: np.ndarray, kind: type) -> np.ndarray:
    """A row of letter counts per word."""
    rows = np.repeat(np.arange(len(codes)), codes.shape[1])
    return np.bincount(rows * 256 + codes.ravel(), minlength=256 * len(codes)).reshape(-1, 256)[:, _USED].astype(kind)


_USED = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)])


def _edited(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows are one edit apart: words of one length, or ``b`` longer by one letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    ahead = np.cumprod(a == b[:, :-1], axis=1).sum(1)
    behind = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return ahead + behind >= a.shape[1]


def _gram_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two blocks at a squared distance of letter counts of at most two."""
    kind = np.float32 if b.shape[1] <= 2048 else np.float64  # all products exact
    x, y = _counts(a, kind), _counts(b, kind)
    near = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T) <= 2
    return np.nonzero(near)


def near_pairs(words: DataFrame, tmp: Scratch) -> DataFrame:
    """``word, n, near, near_n`` for words one inserted, deleted or replaced letter apart, each pair in both directions.

    One edit changes the letter counts by a squared distance of at most two, and the
    number of letters of each class likewise: a block only meets those of its own class
    counts, of a letter moved to another class, and of one letter more. Blocks are
    multiplied as matrices of letter counts; what lies within two is held against the
    words themselves.
    """
    blocks = tmp.staged(_blocks(words), "blocks")
    cell = F.col("cell")
    # the cells whose blocks meet this one: each unordered pair of cells of one length comes once
    sent = [F.struct(cell.alias("to"), F.lit(True).alias("same"))]
    sent += [F.when(cell[i] > 0, F.struct(_moved(cell, i, j).alias("to"), F.lit(False).alias("same"))) for i in range(CLASSES) for j in range(i + 1, CLASSES)]
    sent += [F.when(cell[i] > 0, F.struct(_moved(cell, i, None).alias("to"), F.lit(False).alias("same"))) for i in range(CLASSES)]
    right = blocks.withColumn("s", F.explode(F.filter(F.array(*sent), lambda s: s.isNotNull())))
    right = right.select(F.col("s.to").alias("to"), F.col("s.same").alias("same"), F.col("block").alias("r_block"), F.col("length").alias("r_length"), F.col("letters").alias("r_letters"), F.col("n").alias("r_n"))
    met = blocks.join(right, F.col("cell") == F.col("to")).where("NOT same OR block <= r_block")
    met = met.select(F.xxhash64("cell", "block").alias("left"), "length", "letters", "n", (F.col("same") & (F.col("block") == F.col("r_block"))).alias("itself"), "r_length", "r_letters", "r_n")

    def tile(rows: list) -> Iterator[pd.DataFrame]:
        a, n = _codes(rows[0].letters, rows[0].length), np.asarray(rows[0].n)
        b, m = np.concatenate([_codes(r.r_letters, r.r_length) for r in rows]), np.concatenate([r.r_n for r in rows])
        i, j = _gram_pairs(a, b)
        if rows[0].itself:
            i, j = i[i < j], j[i < j]
        ok = np.concatenate([_edited(a[i[k : k + 4096]], b[j[k : k + 4096]]) for k in range(0, len(i), 4096)] or [np.zeros(0, bool)])
        i, j = i[ok], j[ok]
        if len(i):
            names, others = [_text(a[x]) for x in i], [_text(b[x]) for x in j]
            yield pd.DataFrame({"word": names + others, "n": np.concatenate([n[i], m[j]]), "near": others + names, "near_n": np.concatenate([m[j], n[i]])})

    def tiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, rows in groupby(f.itertuples(index=False), key=lambda r: (r.left, r.itself, r.r_length)):
                held, size = [], 0
                for r in rows:
                    held.append(r)
                    size += len(r.r_n)
                    if size >= TILE_WORDS:
                        yield from tile(held)
                        held, size = [], 0
                if held:
                    yield from tile(held)

    return met.mapInPandas(tiles, "word string, n long, near string, near_n long")


def _text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le")


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``word, n``.

    A word's form is its near word of largest ``n``, of equal ones the first by code
    points, if that is at least ``ratio`` times its own; its root is what its forms lead
    to. Words are distinct letters a-z and U+00C0 to U+00FF. Words without near words
    have ``n_near`` 0, no form, and are their own root; an empty table gives an empty table.
    """
    with Scratch(words.sparkSession, "spelling") as tmp:
        words = tmp.staged(words, "words")
        pairs = near_pairs(words, tmp)
        best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best")
        near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best).withColumnRenamed("word", "_word")
        takes = -F.col("best.minus") >= ratio * F.col("n")
        found = words.join(near, F.col("word") == F.col("_word"), "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.minus")).alias("form_n")
        )
        found = tmp.staged(found, "found")
        at = tmp.staged(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
        while True:  # each round doubles the steps that a root stands for
            further = at.join(at.select(F.col("word").alias("_at"), F.col("root").alias("_root")), F.col("root") == F.col("_at"), "left")
            before, at = at, tmp.staged(further.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
            tmp.drop(before)
            if not at.where("moved").limit(1).count():
                break
            at = at.drop("moved")
        roots = at.select(F.col("word").alias("_word"), "root")
        out = found.join(roots, F.col("word") == F.col("_word"), "left")
        return staged(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
