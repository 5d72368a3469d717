"""Operators and the whole pipeline against versions written plainly, text by text."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cohortlens.llm import langid, neardup, quality, toxicity
from cohortlens.llm.common import fields, table

from test_operators import brute_components, brute_statistics


def walk(trees, x):
    """Margin of one row, node by node."""
    total = trees.start
    for t in range(len(trees.feature)):
        node = 0
        while trees.feature[t, node] >= 0:
            node = trees.left[t, node] + (x[trees.feature[t, node]] > trees.cut[t, node])
        total += trees.value[t, node]
    return total


def plain_features(text):
    """The ratios that the trees read, from counts of the text."""
    words, chars, symbols, dup, repeat = brute_statistics(text)
    own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    upper = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text or "")
    return [math.log1p(words), chars / max(words, 1), symbols / max(chars, 1), dup / max(len(lines), 1), repeat / max(words, 1),
            upper / max(chars, 1), len(set(own)) / max(words, 1)]


def plain_quality(text, trees):
    words, _, _, _, repeats = brute_statistics(text)
    chance = 1 / (1 + math.exp(-max(-30, min(30, walk(trees, plain_features(text))))))
    failed = words < 50 or 100 * repeats > 50 * words
    return chance, not failed and chance >= quality.THRESHOLD


def test_flat_trees_equal_walking():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.random(800) > 0.2).astype(float)
    trees = quality.grow(x, y, [0, -1, 0], rounds=12)
    some = rng.random((60, 3))
    assert trees.margin(some) == pytest.approx([walk(trees, row) for row in some])
    # Never better with more of the second feature.
    up = some.copy()
    up[:, 1] += rng.random(60)
    assert (trees.margin(up) <= trees.margin(some) + 1e-12).all()


def test_quality_verdicts(spark, sf):
    docs, labels = table(spark, sf, "documents").limit(80), table(spark, sf, "labels")
    trees = quality.train(docs, labels)
    got = fields(quality.judge(docs, trees), ["doc_id", "text"], ["score", "kept"]).collect()
    for r in got:
        chance, kept = plain_quality(r.text, trees)
        assert r.score == pytest.approx(chance) and r.kept == kept


def letters_of(text):
    out = []
    for char in text or "":
        code = ord(char)
        if not char.isalpha():
            out.append(0)
            continue
        low = char.lower() if code <= 0xFFFF else char
        at = ord(low) if len(low) == 1 else code
        out.append(at - 96 if 97 <= at <= 122 else 27 + at % (langid.SYMBOLS - 27))
    return out


SEEDS = np.random.default_rng(20240501).choice(np.array([-1, 1], np.int8), (langid.SYMBOLS, langid.DIMENSIONS)).astype(float)


def text_vector(text):
    """Bind each pair of neighbouring letters, the first one turned by a place, and add up; with the number of letters."""
    symbols = [0, *letters_of(text), 0]
    pairs = Counter(p for p in zip(symbols, symbols[1:]) if p != (0, 0))
    vector = sum((n * np.roll(SEEDS[a], 1) * SEEDS[b] for (a, b), n in pairs.items()), np.zeros(langid.DIMENSIONS))
    size = math.sqrt(sum(n * n for n in pairs.values()))
    return vector, size, sum(s > 0 for s in symbols)


def plain_languages(pairs):
    """name -> unit vector apart from the centre, and the centre, of (lang, text) pairs."""
    sums = {}
    for lang, text in pairs:
        vector, size, letters = text_vector(text)
        if lang is not None and letters:
            sums[lang] = sums.get(lang, 0) + vector / size
    unit = {n: v / np.linalg.norm(v) for n, v in sums.items()}
    centre = np.mean(list(unit.values()), axis=0) if len(unit) > 1 else np.zeros(langid.DIMENSIONS)
    return {n: (v - centre) / np.linalg.norm(v - centre) for n, v in unit.items()}, centre


def plain_language(text, languages, centre):
    vector, _, letters = text_vector(text)
    if not letters or not languages:
        return "und", 0.0
    own = vector / np.linalg.norm(vector) - centre
    cosines = {n: float(own @ v / np.linalg.norm(own)) for n, v in sorted(languages.items())}
    best = max(cosines, key=lambda n: cosines[n])
    return best, min(max(cosines[best], 0.0), 1.0)


def test_language_cosines(spark, sf, rows):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text").limit(60).unionByName(rows.select("doc_id", "lang", "text"))
    docs = docs.filter("length(text) < 20000 or text is null")
    own = docs.collect()
    languages, centre = plain_languages([(r.lang, r.text) for r in own])
    for r in fields(langid.identify(docs, langid.train(docs)), ["doc_id", "text"], ["lang_pred", "score"]).collect():
        name, cosine = plain_language(r.text, languages, centre)
        assert r.lang_pred == name and r.score == pytest.approx(cosine, abs=1e-4)


def test_noisy_or_and_spans(rows, spark):
    random.seed(3)
    model = toxicity.Model(-3.0, np.array([toxicity.slot(b"bad"), toxicity.slot(b"worse"), toxicity.slot(b"fine")]), np.array([2.5, 4.0, -1.0]))
    texts = [" ".join(random.choices(["bad", "Worse", "fine", "calm.", "so!", "x\n", "é"], k=random.randrange(14))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100, None), (101, "..!\n")], "doc_id long, text string")
    weights = {"bad": 2.5, "worse": 4.0, "fine": -1.0}
    for r in fields(toxicity.score(df, model), ["doc_id", "text"], ["score", "offending"]).collect():
        clean, spans = 1.0, []
        for sentence in re.finditer(r"[^.!?\n]+", r.text or ""):
            words = re.findall(r"[a-z0-9'\x80-\U0010ffff]+", sentence[0].lower())
            if words:
                p = 1 / (1 + math.exp(3.0 - sum(weights.get(w, 0.0) for w in set(words))))
                clean *= 1 - p
                if p >= 0.5:
                    spans.append((len(r.text[: sentence.start()].encode()), len(r.text[: sentence.end()].encode()), p))
        assert r.score == pytest.approx(1 - clean, abs=1e-12)
        assert [(o.start, o.end) for o in r.offending] == [s[:2] for s in spans]
        assert [o.score for o in r.offending] == pytest.approx([s[2] for s in spans])


def test_a_hot_labelled_id_changes_nothing(spark):
    """A third of all rows under one labelled id: one of them is learned from, and the fit is the same."""
    random.seed(5)
    calm = [f"w{i}" for i in range(40)]
    data = [(i, " ".join(random.choices(calm, k=12)) + (". so nasty here" if i % 3 == 0 else "."), int(i % 3 == 0)) for i in range(240)]
    plain = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    hot = plain.unionByName(spark.range(120).select(F.lit(7).cast("long").alias("doc_id"), F.lit(data[7][1]).alias("text"), F.lit(0).alias("toxic")))
    labels = plain.select("doc_id", "toxic", F.col("toxic").alias("quality"))
    one, two = toxicity.train(plain, labels), toxicity.train(hot, labels)
    assert one.bias == two.bias and np.array_equal(one.slots, two.slots) and np.array_equal(one.weights, two.weights)
    assert len(one.slots) and toxicity.train(plain, labels, sample_words=0).slots.size == 0
    first, second = quality.train(plain, labels), quality.train(hot, labels)
    assert all(np.array_equal(getattr(first, n), getattr(second, n)) for n in ("feature", "cut", "left", "value"))


def test_pipeline_rows(spark, sf, tmp_path):
    """``run`` on a small folder: what each stage keeps, both ways, and every piece."""
    docs = table(spark, sf, "documents").limit(90)
    extra = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 100000)  # copies
    odd = docs.limit(2).withColumns({"doc_id": F.col("doc_id") + 200000, "text": F.when(F.col("doc_id") < 0, F.col("text"))})
    docs.unionByName(extra).unionByName(odd).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels = table(spark, sf, "labels")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    corpus_pipeline.quality_rules(spark, docs, str(tmp_path))  # finds the package for workers
    trees = quality.train(docs, labels)
    kept = {d: lt for d, lt in texts.items() if plain_quality(lt[1], trees)[1]}
    assert kept and len(kept) < len(texts)
    languages, centre = plain_languages(kept.values())
    known = {}
    for d, (lang, text) in kept.items():
        name, cosine = plain_language(text, languages, centre)
        if name != "und" and cosine >= langid.LEAST_COSINE:
            known[d] = text
    root = brute_components(list(known.items()), neardup.PERCENT)[1]
    left = {d: known[d] for d in known if root.get(d, d) == d}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(left) and len(left) < len(known)
    coder = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    sequences = {}
    for doc, text in left.items():
        ids = np.array([*coder.encode(text, add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in pieces if r.doc_id == doc), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist() and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist() and sum(n for _, n in own) <= 4096
