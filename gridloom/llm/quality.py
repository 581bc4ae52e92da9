"""Quality rules: a decision list learnt by sequential covering, emitted as Spark conditionals.

Statistics of every whole text are array and string functions of its own row: no
shuffle, no Python on the executors. From a bounded sample of labelled rows the
driver grows conjunctions of thresholds that pick out low quality, prunes each on
rows held back, and keeps those that stay precise. The ordered list becomes one
``CASE WHEN`` over the statistics of all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE_CLASS, fenced, words

#: Labelled rows learnt from (about): the documented bound of the training sample.
LABELLED_ROWS = 20_000
#: Of a rule: most thresholds, least rows and least share of low quality among the rows it takes, most rules of a list.
MOST_LITERALS, LEAST_ROWS, LEAST_PRECISION, MOST_RULES = 4, 5, 0.9, 24
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "distinct_rate")


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` to a table with the words ``_w``.

    The hash of each 3-word window keeps the window's place in its lowest bits, so
    that one sort of longs brings equal windows together; neighbours with equal
    hashes are compared word by word. The places that remain, in order, give the
    number of words under any repeated window.
    """
    n = F.size("_w")
    df = df.withColumn("_mask", F.expr("shiftleft(1L, greatest(1, length(bin(size(_w))))) - 1"))
    window = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: window(i).bitwiseAND(F.bitwise_not("_mask")).bitwiseOR(i.cast("long")))
    df = df.withColumn("_p", F.when(n >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    at = lambda x: x.bitwiseAND(F.col("_mask")).cast("int")

    def same(x: Column, y: Column) -> Column:
        a, b = at(x), at(y)
        alike = x.bitwiseXOR(y).bitwiseAND(F.bitwise_not("_mask")) == 0
        for k in range(3):
            alike = alike & (F.get("_w", a + k) == F.get("_w", b + k))
        return F.coalesce(alike, F.lit(False))

    found = F.filter("_p", lambda x, i: same(x, F.get("_p", i - 1)) | same(x, F.get("_p", i + 1)))
    df = df.withColumn("_at", F.sort_array(F.transform(found, at)))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
    total = F.aggregate("_at", start, lambda s, p: F.struct(p.alias("last"), (s["sum"] + F.least(F.lit(3), p - s["last"])).alias("sum")), lambda s: s["sum"])
    return df.withColumn("n_repeat_words", total).drop("_mask", "_p", "_at")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The base statistics and the learner's features of every whole text, one row for each row of ``docs``.

    Null and empty texts have no words and rates of 0. Repeated rows give repeated
    rows, null ids stay null, an empty table gives an empty table. Columns of ``docs``
    named in ``keep`` are carried along as ``_kept`` (a struct), so that their names
    can't clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.struct(*[F.col(c) for c in keep]).alias("_kept")] if keep else []
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), words(F.col(text_col)).alias("_w"), *kept)
    df = _repeat_words(df)
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    long = lambda c: c.cast("long")
    df = df.select(
        "doc_id", *(["_kept"] if keep else []), "n_repeat_words",
        long(F.size("_w")).alias("n_words"),
        long(F.length(F.regexp_replace("_t", f"{SPACE_CLASS}+", ""))).alias("word_chars"),
        long(F.regexp_count("_t", F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        long(F.size("_l")).alias("_lines"), long(F.size(F.array_distinct("_w"))).alias("_distinct"),
        long(F.regexp_count("_t", F.lit(r"[A-Z]"))).alias("_upper"), long(F.regexp_count("_t", F.lit(r"[0-9]"))).alias("_digits"),
        long(F.regexp_count("_t", F.lit(r"[.,;:!?]"))).alias("_marks"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return df.select(
        "*", rate("word_chars", "n_words").alias("mean_word"), rate("n_symbols", "word_chars").alias("symbol_rate"), rate("n_dup_lines", "_lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"), rate("_upper", "word_chars").alias("upper_rate"), rate("_digits", "word_chars").alias("digit_rate"),
        rate("_marks", "n_words").alias("mark_rate"), rate("_distinct", "n_words").alias("distinct_rate"),
        fenced((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    ).drop("_lines", "_distinct", "_upper", "_digits", "_marks")


@dataclass(frozen=True)
class Literal:
    """One threshold: ``feature >= value`` or ``feature < value``."""

    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.value if self.above else c < self.value

    def mask(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.value if self.above else v < self.value


Rule = tuple[Literal, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for literal in rule:
        out &= literal.mask(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the threshold of greatest information gain until only low quality is covered."""
    rule: list[Literal] = []
    inside = np.ones(len(x), bool)
    while len(rule) < MOST_LITERALS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        base, best, gain = np.log2(p0 / (p0 + n0)), None, 1e-9
        for k, name in enumerate(FEATURES):
            v = x[inside, k]
            for value in np.unique(np.quantile(v, np.linspace(0.005, 0.995, 67))):
                for above in (True, False):
                    hit = inside & ((x[:, k] >= value) if above else (x[:, k] < value))
                    p, n = (hit & bad).sum(), (hit & ~bad).sum()
                    if p >= LEAST_ROWS and (g := p * (np.log2(p / (p + n)) - base)) > gain:
                        best, gain = Literal(name, above, float(value)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.mask(x)
    return tuple(rule)


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    hit = _covers(rule, x)
    p, n = (hit & bad).sum(), (hit & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """The ordered rules that reject. Two thirds of the rows grow a rule, one third prunes it; deterministic."""
    rules: list[Rule] = []
    third = np.arange(len(x)) % 3 == 0
    open_ = np.ones(len(x), bool)
    while len(rules) < MOST_RULES and (grow := open_ & ~third).any() and (bad & grow).sum() >= LEAST_ROWS:
        rule = _grow(x[grow], bad[grow])
        held = open_ & third
        while len(rule) > 1 and _worth(rule[:-1], x[held], bad[held]) >= _worth(rule, x[held], bad[held]):
            rule = rule[:-1]
        hit = _covers(rule, x) & open_
        if not rule or hit.sum() < LEAST_ROWS or (bad & hit).sum() < LEAST_PRECISION * hit.sum():
            break
        rules.append(rule)
        open_ &= ~hit
    return rules


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Learn from about ``rows`` labelled documents, chosen by a hash of the id; from all if there are fewer.

    Labels with a null id or quality are passed over; of several labels of an id the
    lowest counts. Documents that fail the base rules need no rule and are left out.
    Without labels the list is empty, and every document keeps its base verdict.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    if not n:
        return []
    chosen = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1_000_000)) < F.lit(-(-1_000_000 * rows // n))
    few = docs.where(chosen).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # labelled documents are found by id before their texts are measured
    few = few.join(known.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), "doc_id")
    sample = statistics(few, keep=["quality"]).where("NOT base_failed").select("doc_id", F.col("_kept.quality").alias("quality"), *FEATURES).collect()
    sample.sort(key=lambda r: (r["doc_id"], *[float(r[f]) for f in FEATURES]))
    x = np.array([[float(r[f]) for f in FEATURES] for r in sample]).reshape(len(sample), len(FEATURES))
    return learn(x, np.array([r["quality"] == 0 for r in sample], bool))


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: true for documents to keep."""
    out = F.lit(True)
    for rule in reversed(rules):
        every = rule[0].column()
        for literal in rule[1:]:
            every = every & literal.column()
        out = F.when(every, F.lit(False)).otherwise(out)
    return out


def judged(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Statistics of each document with ``base_failed`` and ``kept``; one map, no shuffle. Cases as in `statistics`."""
    return statistics(docs, id_col, text_col, keep).withColumn("kept", ~F.col("base_failed") & verdict(rules))
