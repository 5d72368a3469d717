"""Boosters against plain numpy, closed forms, and themselves grown the other way."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortlens.operators import boosting
from cohortlens.operators.boosting import Job, Settings


def frame(spark, x, y):
    return spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "features"])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=400).round(2), rng.integers(0, 2, 400), rng.random(400).round(2), np.full(400, 7.0)])
    y = (x[:, 0] + 0.8 * x[:, 1] + rng.normal(size=400) * 0.6 > 0.3).astype(float)
    return x, y


def chances(model, df):
    return np.array([r.probability[1] for r in model.transform(df).collect()])


def stump(x, y):
    """One split by squared error of the residuals over all cuts between quantiles, Newton leaves; features first, then lowest cut."""
    p0 = y.mean()
    g, h = p0 - y, np.full(len(y), p0 * (1 - p0))
    best = (-1, None)
    for f in range(x.shape[1]):
        values = np.sort(x[:, f])
        # The limits of at most 64 bins: values at ranks of equal share.
        limits = np.unique([values[max(int(np.ceil(len(values) * i / 63)) - 1, 0)] for i in range(63)])
        for cut in limits[limits < values[-1]]:
            left = x[:, f] <= cut
            gain = sum(g[s].sum() ** 2 / s.sum() for s in (left, ~left)) - g.sum() ** 2 / len(g)
            if gain > best[0] + 1e-9:
                best = (gain, (f, cut))
    f, cut = best[1]
    left = x[:, f] <= cut
    return np.where(left, -g[left].sum() / h[left].sum(), -g[~left].sum() / h[~left].sum()), np.log(p0 / (1 - p0))


def test_a_stump_equals_numpy(spark, data):
    x, y = data
    df = frame(spark, x, y)
    model = boosting.fit_all([df], [Job(0, Settings(1, 1, 0.5))])[0]
    step, prior = stump(x, y)
    assert chances(model, df) == pytest.approx(1 / (1 + np.exp(-(prior + 0.5 * step))), abs=1e-6)


def test_leaves_have_the_closed_form(spark):
    """Four rows, one useful split: penalised Newton steps by hand."""
    x, y = np.array([[0.0], [0.0], [1.0], [1.0]]), np.array([0.0, 1.0, 1.0, 1.0])
    settings = Settings(1, 3, 0.1, newton=True, reg_lambda=1.5, reg_alpha=0.1)
    model = boosting.fit_all([frame(spark, x, y)], [Job(0, settings)])[0]
    g, h = np.array([0.75, -0.25, -0.25, -0.25]), 0.75 * 0.25
    leaves = [-(abs(s) - 0.1) * np.sign(s) / (2 * h + 1.5) for s in (g[:2].sum(), g[2:].sum())]
    parts = model.ensemble().parts
    assert parts["value"][1:] * 10 == pytest.approx(leaves, abs=1e-6)
    # The split is worth 0.5 (L + R - all) = 0.0779 before gamma.
    worth = lambda s, n: max(abs(s) - 0.1, 0) ** 2 / (n * h + 1.5)
    gain = (worth(0.5, 2) + worth(-0.5, 2) - worth(0.0, 4)) / 2
    for gamma, nodes in ((gain - 1e-3, 3), (gain + 1e-3, 1)):
        grown = boosting.fit_all([frame(spark, x, y)], [Job(0, Settings(1, 3, 0.1, newton=True, reg_lambda=1.5, reg_alpha=0.1, gamma=gamma))])
        assert len(grown[0].ensemble().parts["left"]) == nodes
    weighty = Settings(1, 3, 0.1, newton=True, min_child_weight=2 * h + 1e-3)
    assert len(boosting.fit_all([frame(spark, x, y)], [Job(0, weighty)])[0].ensemble().parts["left"]) == 1


JOBS = [Job(0, Settings(7, 3, 0.3)), Job(1, Settings(5, 4, 0.2, subsample=0.7, colsample=0.6, newton=True, min_child_weight=1.0, reg_lambda=1.0)),
        Job(0, Settings(4, 2, 0.5, subsample=0.8, newton=True, gamma=0.5, reg_alpha=0.2))]


def test_both_ways_give_the_same_trees(spark, data, monkeypatch):
    x, y = data
    tables = [frame(spark, x, y).repartition(3), frame(spark, x[:150], y[:150]).repartition(2)]
    here = boosting.fit_all(tables, JOBS)
    monkeypatch.setattr(boosting, "LOCAL_ROWS", 0)
    monkeypatch.setattr(boosting, "STORE_ROUNDS", 2)
    # Nodes of a level in several passes.
    monkeypatch.setattr(boosting, "MAX_CELLS", 2 * 4 * boosting.MAX_BINS)
    spread = boosting.fit_all([t.repartition(5) for t in tables], JOBS)
    for a, b in zip(here, spread):
        one, two = a.ensemble(), b.ensemble()
        assert one.prior == two.prior
        for name in one.parts:
            assert np.array_equal(one.parts[name], two.parts[name]), name


def test_layout_does_not_matter(spark, data):
    x, y = data
    df = frame(spark, x, y)
    models = [boosting.fit_all([df.repartition(n, "label")], JOBS[:1])[0] for n in (1, 4)]
    assert models[0].getOrDefault("packed") is not None
    assert np.array_equal(models[0].ensemble().parts["value"], models[1].ensemble().parts["value"])


def test_more_rounds_fit_better(spark, data):
    x, y = data
    df = frame(spark, x, y)
    loss = [-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) for p in (
        chances(m, df) for m in boosting.fit_all([df], [Job(0, Settings(n, 3, 0.1)) for n in (1, 10, 60)]))]
    assert loss[0] > loss[1] > loss[2]


def test_odd_tables(spark, tmp_path):
    one_class = frame(spark, np.zeros((5, 2)), np.ones(5))
    model = boosting.fit_all([one_class], [Job(0, Settings(5, 3, 0.1))])[0]
    assert (chances(model, one_class) > 0.999).all()
    constant = frame(spark, np.full((6, 1), 3.0), np.array([0, 1, 0, 1, 1, 1.0]))
    model = boosting.fit_all([constant], [Job(0, Settings(50, 3, 0.1))])[0]
    assert chances(model, constant) == pytest.approx([4 / 6] * 6, abs=1e-6)
    # A round that changes nothing ends the growth.
    assert len(model.ensemble().parts["first"]) < 5
    with pytest.raises(ValueError, match="no labelled rows"):
        boosting.fit_all([constant.filter("label > 2")], [Job(0, Settings(1, 1, 0.1))])
    unlabelled = constant.withColumn("label", F.when(F.col("label") == 0, F.col("label")))
    assert (chances(boosting.fit_all([unlabelled], [Job(0, Settings(1, 1, 0.1))])[0], constant) < 0.001).all()
    model.write().overwrite().save(f"{tmp_path}/booster")
    again = boosting.BoosterModel.load(f"{tmp_path}/booster")
    assert np.array_equal(chances(again, constant), chances(model, constant))
    assert model.transform(constant.limit(0)).count() == 0


def test_a_table_beyond_the_first_bound_needs_no_level_jobs(spark, monkeypatch):
    """40,000 rows stay in one task for each job: a Spark job for each level of 600 trees took too long."""
    from pyspark.ml.functions import array_to_vector

    df = spark.range(40_000).select((F.col("id") % 3 == 0).cast("double").alias("label"),
                                    array_to_vector(F.array(F.col("id") % 7, F.col("id") % 3).cast("array<double>")).alias("features"))
    monkeypatch.setattr(boosting, "level_splits", lambda *a: pytest.fail("a job for a level"))
    model = boosting.fit_all([df], [Job(0, Settings(3, 2, 0.5))])[0]
    assert len(model.ensemble().parts["first"]) == 4


def test_sums_of_a_larger_sister_follow_from_the_parent(monkeypatch):
    """Below the root at most half the rows are added up, and the trees are those of adding up all."""
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 16, (3000, 4)).astype(np.uint8)
    y = (bins[:, 0] * 2 + bins[:, 1] + rng.normal(size=3000) * 6 > 22).astype(float)
    args = bins, y, np.ones(3000), np.arange(3000).astype(np.uint64), Settings(3, 5, 0.3, newton=True), 0.1
    used, plain = [], boosting.sums_by_bin

    def counted(bins, slot, slots, *rest):
        used.append((slots, int((slot >= 0).sum())))
        return plain(bins, slot, slots, *rest)

    monkeypatch.setattr(boosting, "sums_by_bin", counted)
    few = boosting.grow_here(*args)
    assert sum(rows for _, rows in used) <= 3 * 3000 * (1 + 4 / 2)
    monkeypatch.setattr(boosting.Growth, "sisters", lambda self: (list(range(len(self.frontier))), []))
    assert [t.value for t in boosting.grow_here(*args).trees] == [t.value for t in few.trees]


def test_three_hundred_thousand_rows_need_no_level_jobs(spark, monkeypatch):
    """Sixty times sf0.1 has 720,000 training rows; beyond 262,144 each level of each tree was a Spark job."""
    from pyspark.ml.functions import array_to_vector

    df = spark.range(300_000).select((F.col("id") % 3 == 0).cast("double").alias("label"),
                                     array_to_vector(F.array(F.col("id") % 7, F.col("id") % 3).cast("array<double>")).alias("features"))
    monkeypatch.setattr(boosting, "level_splits", lambda *a: pytest.fail("a job for a level"))
    model = boosting.fit_all([df], [Job(0, Settings(3, 2, 0.5, subsample=0.7))])[0]
    assert len(model.ensemble().parts["first"]) == 4


def test_features_in_packs_add_up_as_each_alone(monkeypatch):
    rng = np.random.default_rng(3)
    kind = rng.integers(0, 3, 5000)
    bins = np.column_stack([rng.integers(0, 40, 5000), kind == 0, kind == 1, rng.integers(0, 30, 5000), kind == 2, np.full(5000, 7)]).astype(np.uint8)
    g, h, rows = np.rint(rng.normal(size=5000) * 1e6), np.rint(rng.random(5000) * 1e6), np.flatnonzero(rng.random(5000) < 0.5)
    slot = np.sort(rng.integers(0, 3, len(rows)))
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 700)
    plain = np.zeros((3, 3, 6, 40))
    for f in range(6):
        for part, v in zip(plain, (g, h, np.ones(5000))):
            np.add.at(part[:, f], (slot, bins[rows, f]), v[rows])
    for most in (40, 200, 4096):
        packs = boosting.together(bins, 40, most)
        assert sorted(f for p in packs for f in p.features) == list(range(6)) and all(p.size <= most for p in packs)
        order = [f for p in packs for f in p.features]
        sums = boosting.sums_by_bin(packs, slot, 3, 40, (g, h), rows)
        assert (sums[:, :, np.argsort(order)] == plain).all()
    assert len(boosting.together(bins, 40, 4096)) == 1


def test_rows_that_were_not_drawn_follow_the_splits():
    """Margins after a round are those of the finished trees, drawn rows or not."""
    rng = np.random.default_rng(8)
    bins = rng.integers(0, 12, (40_000, 3)).astype(np.uint8)
    y = (bins[:, 0] + rng.normal(size=40_000) * 3 > 6).astype(float)
    hashes = rng.integers(0, 2**63, 40_000).astype(np.uint64)
    settings = Settings(2, 3, 0.4, subsample=0.6, colsample=0.5, newton=True)
    first, second = boosting.grow_here(bins, y, np.ones(40_000), hashes, settings, 0.1).trees
    margin = 0.1 + np.array(first.value)[boosting.settled(bins, first.arrays())]
    use, (g, h) = boosting.sampled(hashes, settings, 1), boosting.gradients(margin, y, np.ones(40_000))
    assert second.value[0] == pytest.approx(-0.4 * g[use].sum() / h[use].sum(), rel=1e-12)
    assert second.cover[0] == use.sum()


def test_margins_are_those_of_each_tree(monkeypatch):
    """Trees of any shape, one of them a single leaf, over several blocks of rows."""
    rng = np.random.default_rng(6)
    x, edges = rng.normal(size=(900, 3)), [np.linspace(-1, 1, 9)] * 3
    y = (x[:, 0] * x[:, 1] > x[:, 2]).astype(float)
    growth = boosting.grow_here(boosting.binned(x, edges), y, np.ones(900), np.arange(900, dtype=np.uint64), Settings(4, 5, 0.3), 0.1)
    growth.trees.insert(1, boosting.Tree(value=[0.25]))
    want = np.full(900, 0.1)
    for tree in growth.trees:
        want += np.array(tree.value)[boosting.settled(boosting.binned(x, edges), tree.arrays())]
    monkeypatch.setattr(boosting, "SCORE_ROWS", 200)
    assert (boosting.Ensemble.of(growth, edges).margins(x) == want).all()
    assert len(boosting.Ensemble.of(growth, edges).margins(x[:0])) == 0
