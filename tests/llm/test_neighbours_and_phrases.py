"""Curves, R-tree negatives and phrases against brute force on small cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import curves, negatives, phrases

VECTORS = "vec_id long, embedding array<double>, label int, Score string, nth int"


def test_hilbert_is_a_walk():
    side = 16
    cells = np.array([(x, y) for x in range(side) for y in range(side)])
    walk = cells[np.argsort(curves.hilbert(cells, 4))]
    assert sorted(curves.hilbert(cells, 4)) == list(range(side * side))
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def nearest(rows, queries, k=curves.K):
    """The definition, pair by pair."""
    out = {}
    for q, v in queries.items():
        scores = []
        for r, w in rows.items():
            if r != q:
                total = 0.0
                for a, b in zip(v, w):
                    total += a * b
                scores.append((-total, r))
        out[q] = [(r, -s) for s, r in sorted(scores)[:k]]
    return out


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_curves_odd_rows(spark):
    data = [(i, [float(x) for x in np.random.default_rng(i).normal(size=5)], 0, "a", 1) for i in range(60)]
    data += [(100 + i, [1.0, 2.0, 3.0, 0.0, -1.0], 0, "b", 2) for i in range(30)]  # many copies of one vector
    data += [(200, None, 0, "c", 3), (201, [0.0] * 5, 0, "d", 3), (202, [1.0, None, 0.0, 0.0, 0.0], 0, "", None),
             (203, [1.0, math.nan, 0.0, 0.0, 0.0], 0, None, 1), (204, [math.inf, 0.0], 0, None, 1), (None, [1.0] * 5, 0, None, 1),
             (205, [3.0, 4.0], 0, None, 1), (5, [9.0] * 5, 0, None, 1), (205, [3.0, 4.0], 0, None, 1), (206, [], 0, None, 1)]
    df = spark.createDataFrame(data, VECTORS)
    got = defaultdict(list)
    for r in curves.search(df, df.filter("vec_id % 5 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    table = {}
    for i, v, *_ in sorted((d for d in data if d[0] is not None and usable(d[1]) and any(d[1])), key=lambda d: (d[0], d[1])):
        table.setdefault(i, v)
    assert dict(got) == nearest(table, {i: v for i, v in table.items() if i % 5 == 0})
    assert curves.search(df.limit(0), df).count() == 0 and curves.search(df, df.limit(0)).count() == 0


def test_curves_reach_and_recall(spark, monkeypatch):
    """Clustered vectors in many blocks: windows are narrow, and still hold nine of ten neighbours."""
    random_ = np.random.default_rng(7)
    centres = random_.normal(size=(60, 12)) * 4
    points = centres[random_.integers(0, 60, 6000)] + random_.normal(size=(6000, 12)) * 0.2
    points /= np.sqrt((points**2).sum(axis=1))[:, None]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(curves, "BLOCK", 100)
    chosen = []
    real = curves.measure
    monkeypatch.setattr(curves, "measure", lambda *a: chosen.append(real(*a)) or chosen[-1])
    got = defaultdict(set)
    for r in curves.search(df, df.filter("vec_id % 20 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert len(chosen) == 1 and chosen[0].curves * (2 * chosen[0].blocks + 1) < 60
    scores = points @ points.T
    np.fill_diagonal(scores, -np.inf)
    found = [len(got[q] & set(np.argsort(-scores[q])[:20].tolist())) for q in range(0, 6000, 20)]
    assert sum(found) / (20 * len(found)) >= 0.9 and all(len(got[q]) == 20 for q in range(0, 6000, 20))


def test_reach_prefers_the_cheapest():
    apart = np.array([[5, 0], [0, 4], [1, 1]])
    assert curves.Reach.least(apart, 100) == (2, 1)
    assert curves.Reach.least(np.full((50, 2), 6), 8) == (1, 7)


def hard(rows, anchors, k=5):
    """The definition: (anchor, positive, rank, negative, scores)."""
    grid = {i: ([math.floor(256 * x) for x in v], label) for i, v, label in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a in anchors:
        v, label = grid[a]
        ranked = sorted((-dot(v, w), r) for r, (w, _) in grid.items() if r != a)
        for p, positive in [(s, r) for s, r in ranked if grid[r][1] == label][:k]:
            window = [(s, r) for s, r in ranked if grid[r][1] != label and -80 * p <= -100 * s <= -100 * p][:k]
            out |= {(a, positive, n + 1, r, -p, -s) for n, (s, r) in enumerate(window)}
    return out


@pytest.mark.parametrize("tile", [1 << 14, 40])
def test_negatives_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(negatives, "TILE", tile)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    random_ = random.Random(5)
    data = [(i, [round(random_.gauss(0.02, 0.05), 2) for _ in range(4)], random_.randrange(3), "a", 1) for i in range(300)]
    data += [(1000 + i, [0.05, 0.05, 0.01, 0.0], i % 2, "b", 2) for i in range(150)]  # a hot vector, two labels
    table = [(i, v, label) for i, v, label, *_ in data]
    data += [(2000, None, 1, None, None), (2001, [0.1] * 4, None, None, None), (2002, [None, 0.1], 1, None, None),
             (2003, [math.nan] * 4, 1, None, None), (None, [0.1] * 4, 1, None, None), (10, [9.0] * 4, 2, "late", 1)]
    data += [(2100, [0.0] * 4, 1, "", 0), (2101, [0.2], 1, "", 0)]
    table += [(2100, [0.0] * 4, 1), (2101, [0.2, 0.0, 0.0, 0.0], 1)]
    table = [(10, *min((v, label) for i, v, label in [*table, (10, [9.0] * 4, 2)] if i == 10)) if t[0] == 10 else t for t in table]
    first = min(((label, v) for i, v, label, *_ in data if i == 10))
    table = [(10, first[1], first[0]) if t[0] == 10 else t for t in table]
    df = spark.createDataFrame(data, VECTORS)
    got = negatives.mine(df, F.col("vec_id") % 10 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == hard(table, [t[0] for t in table if t[0] % 10 == 0])
    assert negatives.mine(df.limit(0), F.col("vec_id") > 0).count() == 0
    assert negatives.mine(df, F.lit(None).cast("boolean")).count() == 0


def test_negatives_refuse_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, [1e15, 1.0], 1), (2, [1e15, 2.0], 2)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="64 bits"):
        negatives.mine(df, F.col("vec_id") == 1)


def test_boxes_bound_all_products():
    random_ = np.random.default_rng(3)
    x = random_.integers(-50, 50, (3000, 6)).astype(float)
    tree = negatives.RTree(x, np.arange(3000), np.zeros(3000, int))
    anchors = random_.integers(-50, 50, (10, 6)).astype(float)
    least, most = tree.intervals(anchors)
    product = anchors @ tree.x.T
    for leaf in range(tree.leaves):
        rows = slice(leaf * negatives.LEAF, (leaf + 1) * negatives.LEAF)
        assert (least[:, leaf] <= product[:, rows].min(axis=1)).all() and (most[:, leaf] >= product[:, rows].max(axis=1)).all()
    assert (most[:, -1] >= product.max(axis=1)).all() and len(tree.below[-1]) == len(tree.below) - tree.leaves - 1
    # A product of large integers is exact in the integer type.
    big = np.array([[3037000499, 1], [3037000498, 0]])
    assert negatives.RTree(big, np.arange(2), np.zeros(2, int)).x.dtype == np.int64


def collocations(texts, limit, longest=3, least=10, covered=50):
    """The definition, with Python integers."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, n = defaultdict(Counter), Counter()
    for lang, text in texts:
        lang = lang if lang is not None else "und"
        text = (text or "").translate(fold)
        for mark in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(mark, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for width in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(len(q) > len(p) and inside(q) and 100 * b >= covered * a for q, b in candidates.items()):
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("limit,longest", [(2000, 3), (3, 3), (15, 3), (4, 2), (6, 4), (1000, 4)])
def test_phrases_equal_brute_force(spark, limit, longest):
    random_ = random.Random(limit + longest)
    words = ["a", "B", "c", "dé", "E", "日本", "x\x00y", "g"]
    texts = []
    for _ in range(160):
        parts = []
        for _ in range(random_.randrange(12)):
            parts += random_.choice([["New", "York", "City"], ["of", "the"], [random_.choice(words)], ["un\tdeux  trois", "quatre", "cinq"]])
            parts.append(random_.choice(["", "", "", ".", ";\n", "\r", "\x0b!"]))
        texts.append((random_.choice(["en", "fr", None, "en"]), " ".join(parts)))
    texts += [("en", None), (None, ""), ("de", "only once"), ("", "q w " * 30), ("en", "tail spin " * 20000)]
    df = spark.createDataFrame([(l, t, "z", 1) for l, t in texts], "lang string, text string, phrase string, N int")
    got = phrases.mine(df, limit=limit, longest=longest)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == collocations(texts, limit, longest)


def test_phrases_of_nothing(spark):
    assert phrases.mine(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_cut_scores_are_exact(spark):
    a, l, r = 10**13 + 7, 3 * 10**13 + 1, 2 * 10**13 + 9
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    assert df.select(phrases.at_cut(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**6 * a * a // (l * r)
