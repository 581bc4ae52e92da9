"""URL verdicts: host and path rules, then logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled URL table: rows with a stated
verdict (those below, or the caller's, of at most `MOST_LABELS` rows), and a sample
of the pages' own urls, one a host, of at most `MOST_BACKGROUND` hosts. A first model of the
stated rows alone takes those out of the sample which may be bad; the others count as
allowed in the second, so that it knows what common hosts and paths look like (two-step
learning from positive and unlabelled examples). The model is a vector of `DIMS`
weights. Every URL is judged in one map without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS, GRAMS, MOST_LABELS, MOST_BACKGROUND, LONGEST_SAMPLED = 1 << 15, (3, 4, 5), 10_000, 2_000, 2_048
#: Sampled urls count as allowed only if the first model gives block less than this probability.
RELIABLE = 1 / 3

#: (host and path, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The rows with a stated verdict: names of the subjects that public URL lists sort out (medicines, gambling, adult, loans, copies,
#: spam, frauds) and neutral ones, beside paths of both kinds, so that either tells by itself.
BLOCKED_NAMES = (
    "buy-pills-online", "discount-pharmacy", "cheap-meds", "pills-outlet", "viagra-shop",
    "online-casino", "best-casino-bonus", "live-casino", "poker-room", "free-slots", "bets-today", "sports-betting",
    "adult-video", "xxx-cams", "hot-adult-chat", "payday-loans", "quick-cash-loans", "replica-watches", "lottery-winner",
    "spam-mailer", "spam-links", "link-farm", "free-followers", "miracle-diet", "cracked-keygen",
)
ALLOWED_NAMES = (
    "library", "garden-club", "daily-news", "museum", "university", "weather", "open-project", "recipes", "local-history", "science",
    "transport", "city-hall", "travel-notes", "music-school", "theatre", "children-books", "mountain-huts", "river-trust", "printing", "astronomy",
    "press", "forum", "shop-windows", "harbour", "letters", "botany", "chess", "cycling", "sewing", "hospital", "railway", "orchard", "sheep-farm", "free-software",
)
BLOCKED_PATHS = ("/cheap-pills/order", "/casino/free-spins", "/poker-bonus.html", "/adult/videos/12", "/payday-loan/apply", "/replica-watches", "/viagra-without-prescription", "/win-the-lottery")
ALLOWED_PATHS = ("", "/en/12", "/de/257/", "/fr/4380", "/es/14605.html", "/en/39121", "/", "/recipes/apple-cake", "/articles/2019/harbour", "/about", "/search/maps.html", "/history/1", "/orders/2020", "/p/7.html", "/video/lecture-3", "/news/1", "/loan-desk/hours", "/de/", "/watch-tower")
ALLOW_SHARE = 0.5
_PREFIXES = ("", "www.", "m.", "blog.")
_DOMAINS = ("example.com", "example.org", "example.net")
LABELLED = tuple(
    (f"{_PREFIXES[(i + j) % len(_PREFIXES)]}{name}.{_DOMAINS[(i + 2 * j) % len(_DOMAINS)]}", path, y)
    for y, names, paths in ((1, BLOCKED_NAMES, ALLOWED_PATHS), (0, ALLOWED_NAMES, ALLOWED_PATHS), (1, ALLOWED_NAMES, BLOCKED_PATHS), (1, BLOCKED_NAMES, BLOCKED_PATHS))
    for i, name in enumerate(names)
    for j, path in enumerate(paths)
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path by the first ``://``; both empty for a null url or one without it."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as ``struct(rule, verdict)``, else null. Of rules equally long the earlier one wins."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(reversed(rules), key=lambda r: len(r[0])):
        of, _, rest = rule.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(f"/{rest}"))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


@lru_cache(maxsize=100_000)
def _buckets(part: str, text: str) -> np.ndarray:
    raw = f"^{text}$".encode()
    return np.array([zlib.crc32(part.encode() + raw[k : k + n]) % DIMS for n in GRAMS for k in range(len(raw) - n + 1)], np.int64)


def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with their weights; each of host and path has length one."""
    parts = [(b, np.full(len(b), 1 / np.sqrt(len(b)))) for b in (_buckets("h", host), _buckets("p", path)) if len(b)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate([b for b, _ in parts]), np.concatenate([w for _, w in parts])


def background(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, most: int = MOST_BACKGROUND, url_col: str = "url") -> list[tuple[str, str, int]]:
    """``(host, path, 0)`` of at most ``most`` hosts, those of the smallest hash, each with that path of its own which has the smallest hash.

    Hosts without a name, urls that a rule decides and those of more than
    `LONGEST_SAMPLED` characters take no part. A host of a third of all rows is one row
    after the partial aggregation. In the order of the hashes, so that reruns agree.
    """
    if most <= 0:
        return []
    host, path = host_and_path(F.col(url_col))
    rows = pages.where(F.length(url_col) <= LONGEST_SAMPLED).select(host.alias("host"), path.alias("path"))
    rows = rows.where((F.col("host") != "") & matching_rule(F.col("host"), F.col("path"), rules).isNull())
    each = rows.groupBy("host").agg(F.min(F.struct(F.xxhash64("host", "path").alias("h"), "path")).alias("of"))
    sample = each.select("host", F.col("of.path").alias("path")).orderBy(F.xxhash64("host"), "host").limit(most)
    return [(r["host"], r["path"], 0) for r in sample.collect()]


def train(labelled: Sequence[tuple[str, str, int]] = LABELLED, rounds: int = 600, rate: float = 2.0, momentum: float = 0.9, decay: float = 1e-5) -> np.ndarray:
    """Weights and, last, the intercept: full-batch gradient descent with momentum and L2 decay. Deterministic.

    All rows to allow together weigh `ALLOW_SHARE` of the table, however many they are.
    """
    if len(labelled) > MOST_LABELS:
        raise ValueError(f"at most {MOST_LABELS} labelled rows are taken")
    known = [features(h, p) for h, p, _ in labelled]
    y = np.array([k for _, _, k in labelled], float)
    row, at = np.repeat(np.arange(len(known)), [len(a) for a, _ in known]), np.concatenate([a for a, _ in known] or [np.zeros(0, np.int64)])
    value = np.concatenate([v for _, v in known] or [np.zeros(0)])
    share = np.where(y == 0, ALLOW_SHARE / max(1, (y == 0).sum()), (1 - ALLOW_SHARE) / max(1, (y == 1).sum()))
    weights, step = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    for _ in range(rounds):
        z = np.bincount(row, value * weights[at], minlength=len(known)) + weights[-1]
        err = share * (1 / (1 + np.exp(-z)) - y)
        grad = np.append(np.bincount(at, err[row] * value, minlength=DIMS), err.sum())
        step = momentum * step - rate * (grad + decay * np.append(weights[:-1], 0.0))
        weights += step
    return weights


def score(weights: np.ndarray, host: str, path: str) -> float:
    """Log odds of block; minus infinity without any n-gram."""
    at, value = features(host, path)
    return float(weights[at] @ value + weights[-1]) if len(at) else -np.inf


def train_on(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, str, int]] = LABELLED, most: int = MOST_BACKGROUND, url_col: str = "url") -> np.ndarray:
    """Weights from ``labelled`` and from those of the `background` of ``pages`` to which a model of ``labelled`` alone gives less than `RELIABLE`.

    Each sampled path is also put beside a host that ``labelled`` only blocks, so that
    what is usual in a path doesn't speak for its host.
    """
    stated = train(labelled)
    reliable = [row for row in background(pages, rules, most, url_col) if score(stated, *row[:2]) < np.log(RELIABLE / (1 - RELIABLE))]
    bad = sorted({h for h, _, y in labelled if y} - {h for h, _, y in labelled if not y})
    beside = [(bad[k % len(bad)], path, 1) for k, (_, path, _) in enumerate(reliable)] if bad else []
    return train([*labelled, *reliable, *beside]) if reliable else stated


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, str, int]] = LABELLED, most_background: int = MOST_BACKGROUND, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every url; the rule's verdict goes before the model's.

    The model learns from ``labelled`` and from a `background` of ``pages`` (none, if ``most_background`` is 0).

    ``score`` is the model's probability of block. Null urls and those without
    ``://`` have empty host and path; without any n-gram there is no evidence, the score
    is 0 and the verdict allow.
    Repeated rows give repeated rows, null ids stay null, an empty table gives an
    empty table, and other columns are not read.
    """
    weights = train_on(pages, rules, labelled, most_background, url_col)
    shared = pages.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # DIMS numbers, whatever the input

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            z = np.array([score(w, h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-z)), pa.float64())], names=[*b.schema.names, "score"])

    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.select(id_col, host.alias("host"), path.alias("path"))
    rows = rows.mapInArrow(scored, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, host string, path string, score double")
    rows = rows.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return rows.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", model).alias("verdict"), "score")
