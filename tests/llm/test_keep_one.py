"""One row of each group, where ids repeat or are null."""

from cohortlens.llm import neardup


def test_keep_one_by_text(spark):
    long = " ".join(f"w{i}" for i in range(80))
    other, third, fourth = (" ".join(f"{c}{i}" for i in range(80)) for c in "xyz")
    data = [(1, long), (2, long + " tail"), (2, other),  # one id, a copy and a text of its own
            (3, third), (3, third), (4, third),  # a repeated row that is first of its group
            (None, third + " end"), (None, fourth), (None, fourth + " end"), (None, ""), (5, None)]
    kept = neardup.keep_one(spark.createDataFrame(data, "doc_id long, text string").repartition(3))
    got = sorted((r.doc_id or 0, (r.text or "").split(" ")[0]) for r in kept.collect())
    assert got == [(0, ""), (0, "z0"), (1, "w0"), (2, "x0"), (3, "y0"), (5, "")]
    assert kept.columns == ["doc_id", "text"]
