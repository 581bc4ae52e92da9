"""Mixing, hard negatives and spelling variants against brute-force versions, on small tables with awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import hard_negatives, mixing, queries, spelling
from tests.oracle import compare

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, schema):
    """With columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, schema)
    for c in ("n", "h", "before", "target", "row", "part", "block", "word", "size", "_key", "tile", "cell"):
        if c not in df.columns:
            df = df.selectExpr("*", f"map('x', 7) AS `{c}`")
    return df


def plain_targets(sizes, weights, share, epochs):
    """Targets by rounds: over the limit stops at it, and the excess is shared by weight among the rest."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total, given = sum(w[s] for s in open_), left
        left = 0.0
        for s in list(open_):
            target[s] += given * w[s] / total
        for s in list(open_):
            if target[s] >= epochs * sizes[s]:
                left += target[s] - epochs * sizes[s]
                target[s] = float(epochs * sizes[s])
                open_.discard(s)
    return target


def mixing_rows(r):
    texts = ["one", "a b c", None, "", "x " * 3000, "  still\x0bmore", "d e f g h i j"]
    rows = [(i, r.choice(texts), r.choice(["src0"] * 5 + ["a", "Z", "é", "", None, "zz"])) for i in range(300)]
    return rows + [(7, "same again", "a")] * 40 + [(None, "no id here", "Z"), (None, None, None), (5, "only", "tiny")]


@pytest.mark.parametrize("weights,share,epochs", [((5, 2, 1), 1.5, 2), ((1, 9), 2.5, 3), ((3,), 0.4, 1)])
def test_mixing(spark, weights, share, epochs):
    rows = mixing_rows(random.Random(3))
    df = frame(spark, rows, "doc_id long, text string, source string").drop("target")
    got = [tuple(x) for x in mixing.mix(df, weights, share, epochs).collect()]
    assert sorted(got, key=repr) == sorted((tuple(x) for x in mixing.mix(df.repartition(7), weights, share, epochs).collect()), key=repr)  # reruns agree
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    want = plain_targets(sizes, weights, share, epochs)
    assert Counter((d, n, n_all) for d, n, n_all, _, _ in got) == Counter((d, len(WORDS.findall(t or "")), sizes[s]) for d, t, s in rows)
    by_size = defaultdict(set)
    for s, n in sizes.items():
        by_size[n].add(round(want[s], 6))
    taken, target = Counter(), {}
    for _, n, n_all, t, k in got:
        assert 0 <= k <= epochs * n and round(t, 6) in by_size[n_all]
        taken[n_all, t] += k
        target[n_all, t] = t
    assert all(taken[k] in (math.floor(t + 0.5), 2 * math.floor(t + 0.5)) for k, t in target.items())  # two sources of one size may share a key


def test_mixing_epochs(spark):
    rows = mixing_rows(random.Random(4))
    mixed = mixing.mix(frame(spark, rows, "doc_id long, text string, source string"), carry=["text", "source", "word"])
    texts = defaultdict(Counter)
    for x in mixing.epoch_rows(mixed).collect():
        assert len(WORDS.findall(x.text)) == x.words and x.epoch in (0, 1)
        texts[x.source][x.epoch] += x.words
    for x in mixed.groupBy("_row.source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect():
        assert sum(texts[x.source].values()) == x["sum(taken)"] == math.floor(x["max(target)"] + 0.5)
        assert not texts[x.source][1] or texts[x.source][0] == x["max(source_size)"]  # the second epoch begins when the first is through


def test_mixing_by_name_and_empty(spark):
    df = spark.createDataFrame([(i, "w " * 10, s) for i in range(20) for s in ("a", "b", None)], "doc_id long, text string, source string")
    got = {x.source_size * 0 + x.target for x in mixing.mix(df, {"a": 3, "b": 1}, share=0.5, epochs=2).collect()}
    assert got == {225.0, 75.0, 0.0}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df.selectExpr("doc_id", "'' AS text", "source")).where("taken > 0 OR target > 0").count() == 0


def test_strassen():
    r = np.random.default_rng(5)
    for m, k, n in [(0, 3, 4), (1, 1, 1), (33, 65, 129), (70, 7, 90), (64, 64, 64), (101, 50, 3)]:
        for leaf in (1, 4, 32):
            a, b = r.integers(-(2**27), 2**27, (m, k)), r.integers(-(2**27), 2**27, (k, n))
            assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()


def plain_negatives(rows, every=50, positives=5, negatives=3, low=50, high=95):
    v = []
    for i, vec, label in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        v.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vec]))
    out = []
    for k, (i, label, q) in enumerate(v):
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p, strict=False)), j, lab) for m, (j, lab, p) in enumerate(v) if m != k)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


def embedding_rows(n=700):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(9)], r.randrange(4)) for i in range(n)]
    rows += [(50, rows[50][1], rows[50][2])] * 2 + [(10_000 + i, rows[3][1], 2) for i in range(60)]  # repeated rows and ties
    rows += [(None, [1.0], 1), (1001, None, 1), (1002, [1.0] * 9, None), (1003, [1.0, None] * 4, 1), (1004, [float("nan")] * 9, 1), (1005, [float("inf")], 1)]
    return rows + [(1050, [], 1), (1100, [0.5, 0.25], 3), (1150, [0.1] * 30, 2), (-50, [0.0] * 9, 1), (-7, [-0.1] * 9, 0)]


def test_hard_negatives(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = embedding_rows()
    df = frame(spark, rows, "vec_id long, embedding array<float>, label int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    want = plain_negatives(rows)
    assert len(want) > 100
    assert sorted(tuple(x) for x in hard_negatives.mine(df, label=label).collect()) == want
    # many small blocks and tiles give the same
    for k, v in {"BLOCK_ROWS": 37, "GROUP_BLOCKS": 2, "TILE_ANCHORS": 3, "LEAF": 2}.items():
        monkeypatch.setattr(hard_negatives, k, v)
    assert sorted(tuple(x) for x in hard_negatives.mine(df.repartition(3), label=label).collect()) == want
    assert hard_negatives.mine(df.limit(0)).count() == 0 and hard_negatives.mine(df.where("vec_id = 3")).count() == 0


def test_hard_negatives_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [3e38], 1), (1, [3e38], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match=r"2\*\*53"):
        hard_negatives.mine(df).count()


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows, least_length=5, least_n=3, one_in=97):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least_n}


def plain_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in form.items() if n[v] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out)


def spelling_rows():
    r = random.Random(8)
    base = ["".join(r.choice("aeinrstléÀ") for _ in range(r.randrange(4, 9))) for _ in range(60)]
    noisy = []
    for w in base * 3:
        i = r.randrange(len(w))
        noisy.append(r.choice([w, w[:i] + w[i + 1 :], w[:i] + r.choice("aestzÿ") + w[i:], w[:i] + r.choice("aestz") + w[i + 1 :]]))
    rows = [(i, " ".join(r.choice(base + noisy) for _ in range(40))) for i in range(200)]
    chain = ["q" * 5] * 3 + ["q" * 6] * 8 + ["q" * 7] * 20 + ["q" * 8] * 60
    rows += [(900, " ".join(chain)), (901, None), (902, ""), (None, "Under No Id: letters letters"), (903, "ß×÷ß×÷ ABCDE abcde Abcde, ÉCOLE école-École's"), (904, "x" * 6000 + " " + "x" * 6001)]
    return rows + [(904, "x" * 6000 + " " + "x" * 6001)] * 3


def test_spelling_variants(spark, monkeypatch):
    rows = spelling_rows()
    df = frame(spark, rows, "doc_id long, text string")
    counts = plain_counts(rows)
    words = spelling.word_counts(df, drop_one_in=97)
    assert {x.word: x.n for x in words.collect()} == counts
    want = plain_variants(counts)
    assert sum(w[1] is not None for w in want) > 20 and max(len({*w[:3]}) for w in want) == 3
    assert sorted((tuple(x) for x in spelling.variants(words).collect()), key=lambda x: x[0]) == want
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 4)
    monkeypatch.setattr(spelling, "TILE_WORDS", 5)
    assert sorted((tuple(x) for x in spelling.variants(words).collect()), key=lambda x: x[0]) == want
    assert spelling.variants(words.limit(0)).count() == 0


def test_spelling_query(spark, sf_dir):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    counts = plain_counts(rows)
    got = queries.op13_spelling_variants(spark, sf_dir).collect()
    assert {x.word: x.n for x in got} == counts
    index = defaultdict(set)  # words with a letter left out, or replaced by a mark
    for w in counts:
        for i in range(len(w)):
            index[w[:i] + "?" + w[i + 1 :]].add(w)
            index[w[:i] + w[i + 1 :]].add(w)
        index[w].add(w)
    near = defaultdict(set)
    for group in index.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    assert {x.word: x.n_near for x in got} == {w: len(near[w]) for w in counts}


@pytest.mark.parametrize("name", ["op11_source_mixing", "op12_hard_negatives"])
def test_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name]) is None
