"""Language identification: known words first, backing off to shorter and shorter character n-grams.

Spark counts all words and n-grams of a bounded sample of labelled documents by
language; they are the model, whose size is so bounded too. A word of the model scores
by its log frequency in each language. An unseen word scores by its known 4-grams, else
by its known 3-grams, and so on. A text's language has the highest sum; the score is
its posterior probability.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled sample learnt from: documents, and characters in them (both about). All of its words and n-grams count, and all texts are scored whole.
TRAIN_DOCS, TRAIN_CHARS = 4_000, 16_000_000
#: Length of the longest n-grams, and what is added to each count.
LONGEST, ALPHA = 4, 0.5
UNKNOWN = "und"
#: Word characters without digits and "_"; among them are numbers such as "½" and "Ⅷ", which are no letters and split words.
_LETTERS = re.compile(r"[^\W\d_]+")
_NUMBERS = re.compile("[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isdecimal() and unicodedata.category(c)[0] != "L") + "]")


def _words(text: str) -> Counter:
    """The words of a text in lower case, runs of letters as \\p{L} has them, with how often each occurs."""
    counts = Counter(_LETTERS.findall(text.lower()))
    for w in [w for w in counts if not w.isascii() and _NUMBERS.search(w)]:
        n = counts.pop(w)
        for part in filter(None, _NUMBERS.split(w)):
            counts[part] += n
    return counts


@dataclass
class Model:
    """Languages, and a line of log frequencies for each known word and n-gram."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    scores: np.ndarray

    def word(self, w: str) -> np.ndarray | None:
        if (k := self.words.get(w)) is not None:
            return self.scores[k]
        padded = f"^{w}$"
        for n in range(LONGEST, 0, -1):
            known = [k for i in range(len(padded) - n + 1) if (k := self.grams.get(padded[i : i + n])) is not None]
            if known:
                return self.scores[known].mean(axis=0)
        return None

    def text(self, text: str | None, seen: dict[str, np.ndarray | None]) -> tuple[str, float]:
        """The language and its probability; `UNKNOWN` and 0 for a text without letters or an empty model."""
        counts = _words(text) if text else {}
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.langs))
        known, times = [], []
        for w, n in counts.items():
            if (k := self.words.get(w)) is not None:
                known.append(k)
                times.append(n)
                continue
            if w in seen:
                v = seen[w]
            else:
                v = self.word(w)
                if len(seen) < 200_000:
                    seen[w] = v
            if v is not None:
                total += n * v
        if known:
            total += np.array(times, float) @ self.scores[known]
        p = np.exp(total - total.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 on division by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = TRAIN_DOCS, most_chars: int = TRAIN_CHARS) -> Model:
    """Learn from the documents that are not held out and have a language and a text.

    A sample of them, chosen by a hash of the id, is learnt from whole, of about
    ``most_docs`` documents and ``most_chars`` characters at the most; all of them if
    they are fewer. Without such documents the model is empty.
    """
    rows = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    n, chars = rows.agg(F.count("*"), F.sum(F.length("_text"))).first()
    share = min(most_docs / max(n, 1), most_chars / max(chars or 0, 1))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * share)))
    words = (
        rows.select("_lang", F.explode(F.split(F.lower("_text"), r"[^\p{L}]+")).alias("w")).where("w <> ''")
        .groupBy("_lang", "w").agg(F.count("*").alias("n")).cache()
    )
    spelled = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    grams = [
        words.where(F.length(spelled) >= k).select("_lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length(spelled) - k + 1), lambda i, k=k: F.substring(spelled, i, F.lit(k)))).alias("w"))
        for k in range(1, LONGEST + 1)
    ]
    all_grams = grams[0].union(grams[1]).union(grams[2]).union(grams[3]).groupBy("_lang", "w").agg(F.sum("n").alias("n"))

    def lines(counts: DataFrame) -> list:
        return counts.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("_lang", "n"))).alias("by")).orderBy("w").collect()

    known_words, known_grams = lines(words), lines(all_grams)
    words.unpersist()
    langs = sorted({x for r in [*known_words, *known_grams] for x in r["by"]})
    tables = []
    for known in (known_words, known_grams):
        c = np.array([[r["by"].get(x, 0) for x in langs] for r in known], float).reshape(len(known), len(langs)) + ALPHA
        tables.append((np.log(c) - np.log(c.sum(axis=0))) if len(c) else c)
    return Model(langs, {r["w"]: k for k, r in enumerate(known_words)}, {r["w"]: len(known_words) + k for k, r in enumerate(known_grams)}, np.concatenate(tables))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text.

    Null texts and texts without letters give ``und`` with score 0. Repeated rows
    give repeated rows, null ids stay null, an empty table gives an empty table, and
    no other column is read. One map, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was learnt from

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = shared.value, {}
        for b in batches:
            found = [m.text(t, seen) for t in b.column(2).to_pylist()]
            columns = [b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(predicted, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
