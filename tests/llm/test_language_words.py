"""Words outside the most frequent hundreds: what follows what, one and two words back."""

import random

import numpy as np
import pytest

from cohortlens.llm import lm
from pyspark.sql import functions as F

FILLERS = [f"filler{i}" for i in range(450)]  # one from 200 on tells nothing of what follows it


@pytest.fixture(scope="module")
def scores(spark):
    random.seed(4)
    lines = []
    for i in range(240):
        words = random.choices(FILLERS, k=700)  # each more often than the words that matter
        # Of one length, first bytes and last byte; and one count.
        words += ["left", "mabcz", *random.choices(FILLERS, k=3), "right", "madez", *random.choices(FILLERS, k=3)]
        words += ["north", random.choice(FILLERS[:200]), "pabcz", *random.choices(FILLERS, k=3), "south", random.choice(FILLERS[:200]), "padez", *random.choices(FILLERS, k=3)]
        lines.append(" ".join(words))
    asked = ["left mabcz", "left madez", "right madez", "right mabcz", "north filler300 pabcz", "north filler300 padez"]
    data = [(i, line) for i, line in enumerate(lines)] + [(1000 + i, line) for i, line in enumerate(asked)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in lm.score(frame, F.col("doc_id") < 1000, passes=20).collect()}
    return {line: got[1000 + i] for i, line in enumerate(asked)}


@pytest.mark.parametrize("seen, unseen", [("left mabcz", "left madez"), ("right madez", "right mabcz"),
                                          ("north filler300 pabcz", "north filler300 padez")])
def test_follows(scores, seen, unseen):
    assert scores[seen].base_score == pytest.approx(scores[unseen].base_score)
    assert scores[seen].score > scores[unseen].score + 0.05


def test_vocabulary_grows():
    classes = [round(n / lm.least_count(n)) for n in (10**5, 10**7, 10**9)]  # room for words of the least count
    assert lm.least_count(0) == lm.LEAST and classes[0] < classes[1] / 5 < classes[2] / 25


def test_normalised():
    noise = np.array([0.5, 0.3, 0.2])
    trainer = lm.Trainer(noise)
    random_ = np.random.default_rng(2)
    for _ in range(50):
        trainer.add(random_.integers(0, 3, 200))
    trainer.flush()
    model = lm.model_of(lm.State.of(trainer.rows(), trainer.share), noise)
    model = model._replace(norm=model.norms(0))
    ends = [model.logs(np.array([1, 2, last]))[2] for last in range(3)]
    assert np.exp(ends).sum() == pytest.approx(1, abs=1e-5)
