"""Small cases of each corpus operator against brute force, round trips and held-out rows."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import bpe, graph, langid, lm, neardup, packing, quality, search, sharding, toxicity, urls
from cohortlens.llm.common import fields, id_fold, table

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference_bpe():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_equals_library_on_odd_texts(reference_bpe):
    random.seed(3)
    pool = ["a", "B", " ", "  ", "\n", "\t", "'s", "'re", "é", "\xa0", "\x1c", "\x85", "日本", "🙂", "23", "́", "!!", "aaaa",
            "<|endoftext|>", "\x00", "İ", "　"]
    own = bpe.Codec(bpe.load_ranks(RANKS), P.PATTERN)
    own.machine.max_states = 50  # states are dropped and made again
    for _ in range(3000):
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 14)))
        ids = own.encode(text)
        assert ids == reference_bpe.encode_ordinary(text)
        assert own.decode(ids) == text


def test_utf8_machine_byte_by_byte():
    random.seed(4)
    for _ in range(3000):
        data = bytes(random.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0xED, 0xA0, 0xFF, 0xE0]) for _ in range(7))
        machine = bpe.Utf8Machine()
        text = "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.close()
        assert text == data.decode("utf-8", "replace")


def test_bpe_query_rows(rows, nothing, reference_bpe):
    got = bpe.round_trip(rows, RANKS, P.PATTERN).collect()
    assert len(got) == rows.count()
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    for r in got:
        ids = reference_bpe.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.round_trip(nothing, RANKS, P.PATTERN).count() == 0
    ids = bpe.encode_texts(rows, RANKS, P.PATTERN)
    back = bpe.decode_ids(ids, RANKS, P.PATTERN).collect()
    assert all(r.decoded == (r.text or "") for r in back)


def brute_statistics(text):
    words = (text or "").encode().split()
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in lines
            lines.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(again)


@pytest.mark.parametrize("text", [None, "", " \n", "a b c a b c a b c", "x\ny\nx\n \nx", "é# <b> ** a b", "a b c d a b c"])
def test_quality_statistics(text):
    want = brute_statistics(text)
    assert quality.statistics(text)[:5] == (want if want[0] else (0,) * 5)


def test_trees_are_monotonic_and_learn():
    random = np.random.default_rng(1)
    x = random.random((3000, 3))
    y = ((x[:, 0] + 0.2 * random.normal(size=3000) < 0.5) & (x[:, 2] > 0.2)).astype(float)
    trees = quality.grow(x, y, [-1, 0, 0], rounds=30)
    assert ((trees.probability(x) > 0.5) == (y > 0)).mean() > 0.85
    for row in x[:40]:
        line = np.repeat(row[None], 50, 0)
        line[:, 0] = np.linspace(0, 1, 50)
        assert (np.diff(trees.margin(line)) <= 1e-12).all()


def test_quality_rows(rows, nothing, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)] + [(1, 1), (None, 1)], "doc_id long, quality int")
    result = quality.judge(rows, quality.train(rows, labels))
    got = fields(result, ["doc_id", "Score"], ["n_words", "base_failed", "kept"]).collect()
    assert len(got) == rows.count()
    assert all(r.base_failed == (r.n_words < 50 or r.doc_id == 9 and r.base_failed) for r in got)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.keep_good(rows, labels).columns == rows.columns
    assert quality.keep_good(nothing, labels.limit(0)).count() == 0


def test_quality_held_out(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    trees = quality.train(docs, labels.filter(id_fold("doc_id", 2) == 0))
    rest = labels.filter(id_fold("doc_id", 2) == 1)
    got = fields(quality.judge(docs, trees), ["doc_id"], ["kept", "base_failed"]).join(rest, "doc_id").filter("NOT base_failed")
    assert got.select(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.8


RULES = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "a.b", "/x"),
         urls.Rule("allow", "a.b", "/x"), urls.Rule("allow", "org", "")]


def brute_url(url):
    host, path = urls.split_url(url)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fit, key=lambda r: r.rank, default=None)
    return host, path, rule.text if rule else None, rule.verdict if rule else "allow"


def test_urls(spark):
    cases = [None, "", "no scheme", "http://", "http://NET/", "http://net", "https://a.net/x?y#z", "x://www.example.net/en/1",
             "x://example.net/enx", "x://notexample.net/en/", "x://c.a.b/xyz", "x://org", "x://org#f", "x://h.org?q://net/", "x://É.NET/"]
    pages = spark.createDataFrame(list(enumerate(cases)) + [(3, "http://")], "page_id int, url string").withColumn("HOST", F.lit(1))
    want = sorted((i, *brute_url(u)) for i, u in [*enumerate(cases), (3, "http://")])
    got = sorted(map(tuple, urls.judge(pages, RULES).collect()), key=lambda r: r[0])
    assert got == want
    distinct = pages.dropDuplicates(["page_id"]).drop("HOST")
    joined = urls.judge_joined(distinct, spark.createDataFrame(RULES, "verdict string, host string, path string"))
    assert sorted(map(tuple, joined.collect()), key=lambda r: r[0]) == sorted(set(want))
    assert urls.judge(pages.limit(0), []).count() == 0


def test_search_is_exact(spark):
    random_ = np.random.default_rng(2)
    near = random_.normal(size=(300, 64))
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(near)] + [(1000 + i, [0.5] * 64) for i in range(40)]
    vectors += [(5, [float(x) for x in near[5]]), (2000, None), (None, [1.0] * 64)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    queries = rows.filter("vec_id in (0, 5, 17, 1003)")
    got = search.top_k(rows, queries, k=7).collect()
    codes = [(i, sum(1 << b for b, x in enumerate(v) if x > 0)) for i, v in vectors if v is not None and i is not None]
    for query in (0, 5, 17, 1003):
        code = dict(codes)[query]
        want = sorted(((c ^ code).bit_count(), i) for i, c in codes)[:7]
        assert [(r.distance, r.neighbour_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == query] == want
    assert search.top_k(rows.limit(0), queries.limit(0)).count() == 0


def test_differencing():
    random.seed(1)
    for _ in range(200):
        sizes = [random.randint(1, 20) for _ in range(random.randint(0, 30))]
        found = packing.near_equal(sizes, 25)
        assert sorted(i for m in found for i in m) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in m) <= 25 for m in found)
    sizes = [8, 7, 6, 5, 4]  # differencing gives 16 and 14 here
    assert sorted(sum(sizes[i] for i in m) for m in packing.difference(sizes, 2)) == [14, 16]


def test_packing(rows, nothing):
    full = Tokenizer.from_file(WORDS)
    full.encode_special_tokens = True
    got = packing.pack(rows, WORDS, capacity=64, piece=16, group_pieces=500).collect()
    ids = [(r.doc_id, [*full.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in rows.collect()]
    assert sum(r.length for r in got) == sum(len(i) for _, i in ids)
    of = dict(ids)
    for r in got:
        piece = np.array(of[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(piece) and r.doc_tokens == len(of[r.doc_id])
    for _, group in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack(nothing, WORDS).count() == 0


def brute_components(texts, percent):
    sets = {}
    for doc, text in texts:
        w = (text or "").encode().lower().split()
        sets[doc] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sorted(sets), 2):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return sets, root


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)  # so that band keys are dealt into blocks
    random.seed(percent)
    texts, at = [], 0
    for _ in range(6):
        words = [f"w{random.randint(0, 999)}" for _ in range(80)]
        for _ in range(20):
            words = list(words)
            for _ in range(random.randint(0, 2)):
                words[random.randrange(len(words))] = f"x{random.randint(0, 999)}"
            texts.append((at, " ".join(words)))
            at += 1
    texts += [(at, texts[3][1].upper()), (at + 1, None), (at + 2, ""), (at + 3, "a b"), (at + 4, "A  b"), (at + 5, "a b c")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    sets, root = brute_components(texts, percent)
    got = neardup.near_duplicates(frame, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        d: (len(sets[d]), root[d], root[d] == d) for d in sets}


def test_near_duplicates_odd_rows(rows, nothing):
    got = neardup.near_duplicates(rows).collect()
    assert len(got) == rows.count()
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and by[8].component_id == 7 and not by[8].kept
    assert by[None].kept and by[None].component_id is None and by[6].n_shingles == 0
    kept = neardup.keep_one(rows)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert neardup.near_duplicates(nothing).count() == 0


def test_signature_estimates_similarity():
    plan = neardup.Plan.of(80)
    random_ = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.8, 1.0):
        items = np.unique(random_.integers(0, 1 << 63, 3000, dtype=np.uint64))
        same = int(len(items) * share)
        other = np.unique(np.concatenate([items[:same], random_.integers(0, 1 << 63, len(items) - same, dtype=np.uint64)]))
        bits = [np.frombuffer(neardup.signature(x, plan)[1], "<u8")[None] for x in (items, other)]
        true = len(np.intersect1d(items, other)) / len(np.union1d(items, other))
        assert abs(neardup.similarity(*bits, plan)[0] - true) < 0.15


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98}


def test_sharding(rows, nothing, spark):
    got = sharding.assign(rows, 8).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in rows.collect()}
    assert all(r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in got)
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for shards in (1, 5, 8):
        all_rows = sharding.assign(many, shards).collect()
        assert all(r.grown_shard in (r.shard, shards) for r in all_rows)
        for shard in range(shards):
            slots = sorted(r.slot for r in all_rows if r.shard == shard)
            assert slots == list(range(len(slots))) and abs(len(slots) - 20000 / shards) < 500
    # A heavier shard: keys move only into the region on its path, in that into its rack, in that into it.
    tree = sharding.even_tree(8)
    heavier = [s._replace(weight=2.0) if s.number == 3 else s for s in tree]
    moved = many.select(sharding.place(F.col("doc_id"), tree).alias("a"), sharding.place(F.col("doc_id"), heavier).alias("b")).filter("a <> b")
    for a, b in moved.distinct().collect():
        if tree[a].region != tree[b].region:
            assert tree[b].region == tree[3].region
        elif tree[a].rack != tree[b].rack:
            assert tree[b].rack == tree[3].rack
        else:
            assert b == 3
    assert moved.filter("b = 3").count() > moved.count() / 2
    assert sharding.assign(nothing, 8).count() == 0


def plain_place(key, tree):
    """Level by level, with numbers of Python."""
    import math
    import struct
    import xxhash

    def draw(name, weight):
        seed = xxhash.xxh64_intdigest(name.encode(), 42)
        bits = xxhash.xxh64_intdigest(struct.pack("<q", key), seed) >> 11
        return -math.log((bits + 0.5) * 2.0**-53) / weight

    path = ""
    for level in ("region", "rack", "number"):
        nodes = {}
        for shard in tree:
            nodes.setdefault(getattr(shard, level), []).append(shard)
        if len(nodes) > 1:
            best = min(nodes, key=lambda n: draw(f"{path}/{n}", sum(s.weight for s in nodes[n])))
        else:
            (best,) = nodes
        path, tree = f"{path}/{best}", nodes[best]
    return tree[0].number


def test_placement_descends_and_grows(spark):
    many = spark.range(3000).select(F.col("id").alias("k"))
    for shards in (1, 3, 8, 9, 12):
        tree = sharding.tree_for(shards)
        got = many.select("k", sharding.place(F.col("k"), tree).alias("s")).collect()
        assert all(r.s == plain_place(r.k, tree) for r in got)
    names = {s: sharding.place(F.col("k"), sharding.tree_for(s)).alias(f"s{s}") for s in range(8, 41)}
    row = many.select(*names.values()).agg(*[F.count_if((F.col(f"s{s}") != F.col(f"s{s + 1}")) & (F.col(f"s{s + 1}") != s)).alias(f"w{s}")
                                            for s in range(8, 40)]).first()
    assert sum(row) == 0


def test_slots_of_a_hot_id(spark):
    """A third of the rows without an id, all alike: no bucket of numbers is large."""
    df = spark.range(30000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"), F.lit(1).alias("Shard"))
    out = sharding.assign(df, 8)
    rows = out.collect()
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({(r.shard, r.grown_shard) for r in rows if r.doc_id is None}) == 1


def test_rules_by_the_thousand(spark):
    """Tails in one node and rules beyond what is sent to tasks give what the plain search gives."""
    rules = [urls.Rule("block" if i % 3 else "allow", "h.org", f"/p{i}") for i in range(2000)] + [urls.Rule("block", "", "/p7/x")]
    pages = [(i, f"http://{'a.' * (i % 3)}h.org/p{i}{'/x' if i % 2 else 'y'}") for i in range(0, 2100, 7)] + [(1, None), (1, None)]
    df = spark.createDataFrame(pages, "page_id int, url string")

    def plain(url):
        host, path = urls.split_url(url)
        fit = [r for r in rules if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit, key=lambda r: r.rank, default=None)

    want = sorted((i, r.text if (r := plain(u)) else "", r.verdict if r else "allow") for i, u in pages)
    table_ = spark.createDataFrame([*rules, (None, "h.org", "/")], "verdict string, host string, path string").filter("verdict is not null")
    for got in (urls.judge(df, rules), urls.judge_joined(df, table_)):
        assert sorted((r.page_id, r.rule or "", r.verdict) for r in got.collect()) == want
    assert urls.judge_joined(df, table_.limit(0)).filter("rule is null and verdict = 'allow'").count() == len(pages)


def test_language(rows, nothing, spark, sf):
    docs = table(spark, sf, "documents")
    held = id_fold("doc_id", 5) == 0
    got = fields(langid.identify(docs, langid.train(docs.filter(~held))), ["doc_id", "lang"], ["lang_pred", "score"]).filter(held)
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9
    odd = fields(langid.identify(rows, langid.train(rows)), ["doc_id"], ["lang_pred", "score"]).collect()
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {4, 5, 6} and all(0 <= r.score <= 1 for r in odd)
    empty = langid.train(nothing)
    assert empty.names == [] and fields(langid.identify(rows, empty), ["doc_id"], ["score"]).count() == rows.count()


def test_gram_counts_by_hand():
    counts, letters = langid.gram_counts(["ab", None, "A1"])
    size = langid.SYMBOLS
    assert counts[0][0 * size + 1] == counts[0][1 * size + 2] == counts[0][2 * size] == 1 and counts[0].sum() == 3
    assert letters.tolist() == [2, 0, 1] and counts[2].sum() == 2


def test_toxicity(rows, nothing, spark):
    random.seed(9)
    calm = [f"word{i}" for i in range(60)]
    data = []
    for i in range(600):
        lines = [" ".join(random.choices(calm, k=8)) for _ in range(6)]
        if i % 4 == 0:
            lines[random.randrange(6)] += " nasty" if i % 8 else " VILE"
        data.append((i, ". ".join(lines), int(i % 4 == 0)))
    frame = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.train(frame, frame.filter("doc_id < 400"))
    got = fields(toxicity.score(frame, model), ["doc_id", "text", "toxic"], ["score", "offending"]).filter("doc_id >= 400").collect()
    assert all((r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in got)
    for r in got:
        spans = [r.text.encode()[o.start : o.end].lower() for o in r.offending]
        assert all(b"nasty" in s or b"vile" in s for s in spans) and bool(spans) == bool(r.toxic)
    odd = fields(toxicity.score(rows, model), ["doc_id", "Score"], ["score"]).collect()
    assert len(odd) == rows.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.train(nothing, frame.limit(0)).weights.size == 0


def test_training_finds_what_follows_what():
    """Trained on a chain of known steps, the normalised distribution comes near to it."""
    random_ = np.random.default_rng(3)
    chain = np.array([[0.02, 0.9, 0.08], [0.5, 0.02, 0.48], [0.1, 0.8, 0.1]])
    walk = [0]
    for u in random_.random(60000):
        walk.append(int(np.searchsorted(chain[walk[-1]].cumsum(), u * 0.999999)))
    # Class 0 ends texts: words are classes 1 to 3.
    words = np.array(walk) + 1
    noise = (np.bincount(words, minlength=4) + 1) / (len(words) + 4)
    trainer = lm.Trainer(noise)
    for _ in range(4):
        trainer.add(words)
    trainer.flush()
    model = lm.model_of(lm.State.of(trainer.rows(), 1e-9), noise)
    model = model._replace(norm=model.norms(0))
    found = np.exp([[model.logs(np.array([a, b]))[1] for b in range(1, 4)] for a in range(1, 4)])
    assert np.abs(found - chain).max() < 0.08


def test_score_is_a_plain_normalised_sum(rows, spark, monkeypatch):
    """The score of each text, recomputed word by word from the model and counts that the job learned."""
    kept = {}
    real = lm.normalised
    monkeypatch.setattr(lm, "normalised", lambda s, m: kept.setdefault("model", real(s, m)))
    gathered = lm.gather
    monkeypatch.setattr(lm, "gather", lambda c: kept.setdefault("own", gathered(c)))
    training = id_fold("doc_id", 7) != 2
    got = lm.score(rows, training).collect()
    model, own = kept["model"], kept["own"]
    scores = [x.astype(float) @ model.target.T.astype(float) + model.bias for x in (model.first, model.second)]
    chance = [np.exp(s) / np.exp(s).sum(axis=1, keepdims=True) for s in scores]
    assert all(np.allclose(c.sum(axis=1), 1) for c in chance)
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    held = {r.doc_id for r in got if r.held_out}
    seen = Counter(w for r in rows.collect() if r.doc_id not in held for w in [*(r.text or "").encode().lower().split(), lm.END_WORD])
    for r in got:
        words = texts[r.doc_id].encode().lower().split()
        hashes, forms = np.append(lm.word_hashes(words), lm.END), np.append(lm.form_of(words), 0)
        classes = own.classes(hashes, forms)[0]
        total, one, two = 0.0, 0, 0
        for i, c in enumerate(classes):
            p = (1 - model.share) * chance[0][one, c] + model.share * chance[1][two, c]
            if c >= own.own:  # the add-one share inside the class of a form
                word = words[i] if i < len(words) else lm.END_WORD
                p *= (seen[word] + 1) / (own.form_total[c - own.own] + own.form_distinct[c - own.own] + 1)
            total += np.log10(p)
            one, two = c, one
        assert r.score == pytest.approx(total, rel=1e-4)


def test_rounds_and_layout(spark, rows, monkeypatch):
    """Several trainers, rounds and files score every text once."""
    monkeypatch.setattr(lm, "SPAN", 1)
    monkeypatch.setattr(lm, "CHUNK", 64)
    monkeypatch.setattr(lm, "ROUNDS", 3)
    got = lm.score(rows.repartition(5), F.lit(True)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == sorted(
        (r.doc_id is None, r.doc_id or 0, len((r.text or "").encode().lower().split()) + 1) for r in rows.collect())


@pytest.mark.parametrize("head", [1 << 17, 8])
def test_language_model(rows, nothing, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)  # with a small head most counts are joined
    got = lm.score(rows, id_fold("doc_id", 7) != 2).collect()
    assert len(got) == rows.count()
    held = {r.doc_id for r in got if r.held_out}
    assert held == {d for d in range(1, 11) if zlib.crc32(str(d).encode()) % 7 == 2}
    split = [(r.doc_id, [*(r.text or "").encode().lower().split(), None]) for r in rows.collect()]
    counts = {}
    for doc, words in split:
        for w in words if doc not in held else ():
            counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    want = {d: (len(w), sum(x in counts for x in w), sum(np.log10((counts.get(x, 0) + 1) / (total + distinct + 1)) for x in w))
            for d, w in split}
    for r in got:
        n, known, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert lm.score(nothing, F.lit(True)).count() == 0


def test_letters_and_marks_are_encoded_once(spark):
    """Words that differ in the marks behind them share the merges of their letters; ids are those of the whole tokenizer."""
    path = P.path("word_bpe_49k.json")
    own = packing.WordTokenizer(path)
    asked, merged = [], own.merged
    own.merged = lambda part: asked.append(part) or merged(part)
    text = "Straße straße, straße! Évén évén, word word, Word!? 12,5 a_b ,x x, naïve. x,y ÀB, àb,"
    got = np.frombuffer(own.packed_ids(text), "<u4").tolist()
    assert got == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) and asked.count("word") == 1
