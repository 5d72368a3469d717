"""Near-duplicates by b-bit MinHash, with every link confirmed on full shingle sets.

1. One pass over the texts gives each document the size of its shingle set, a key of its
   word sequence, band keys of its minima, and the low ``BITS`` bits of each minimum, packed.
2. Documents with the same words are one *class*, named by the smallest id.
3. Classes that share a band key are candidates. The packed bits estimate their similarity
   by bit counts, corrected for chance agreement.
4. First each class is tried with its most similar earlier one of its block of each band key, so
   a key gives fewer pairs than it has members. Then classes that these links left apart meet
   with their full sets where they share a band key; only confirmed links come out.
5. Every link is confirmed on full sets; the components of the links are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.common import arrow_rows, raw, scramble, unused, windows, word_hashes
from cohortlens.llm.graph import components
from cohortlens.session import materialize

WIDTH, PERCENT = 5, 80
#: Minima in a band, low bits kept of each, and the chance of missing a pair right at the threshold.
BAND_ROWS, BITS, MISS = 5, 2, 2e-6
#: Standard errors below the threshold at which an estimate rules a candidate out.
ERRORS = 4.5
#: Members of one band key that meet in one task; larger ones meet block by block.
BLOCK = 1024
#: A pair of blocks is one number: the smaller above so many bits of the larger.
SIDE_BITS = 24
#: Parts of a band key whose members are joined with its count apart from each other.
DEALS = 16
#: Bits of the filter that lets only candidates' texts be read a second time (4 MB, whatever the input).
FILTER_BITS = 1 << 25
CHUNK = 1024
PRINTS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("words_key", pa.binary()),
                    ("bands", pa.list_(pa.int64())), ("bits", pa.binary())])


class Plan(NamedTuple):
    """Numbers that follow from the similarity at which documents are linked."""

    percent: int
    bands: int
    hashes: int
    least: float

    @staticmethod
    def of(percent: int) -> Plan:
        level = percent / 100
        bands = math.ceil(math.log(MISS) / math.log1p(-level**BAND_ROWS)) if level < 1 else 1
        hashes = bands * BAND_ROWS
        chance = 2.0**-BITS
        match = chance + (1 - chance) * level
        return Plan(percent, bands, hashes, level - ERRORS * math.sqrt(match * (1 - match) / hashes) / (1 - chance))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased word shingles; a shorter text is one shingle, a blank one none."""
    words = raw(text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    return np.unique(windows(hashes, min(width, len(words))))


def minima(items: np.ndarray, hashes: int) -> np.ndarray:
    random = np.random.default_rng(20240607)
    factor = random.integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = random.integers(0, 1 << 32, hashes, dtype=np.uint32)
    low = items.astype(np.uint32)
    best = np.full(hashes, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), CHUNK):
        values = low[None, at : at + CHUNK] * factor[:, None]
        values += shift[:, None]
        np.minimum(best, values.min(axis=1), out=best)
    return best


def signature(items: np.ndarray, plan: Plan) -> tuple[np.ndarray, bytes]:
    """Band keys, and the low bits of the scrambled minima packed into 64-bit words."""
    best = scramble(minima(items, plan.hashes).astype(np.uint64) + (np.arange(plan.hashes, dtype=np.uint64) << np.uint64(32)))
    keys = np.zeros(plan.bands, np.uint64)
    for column in best.reshape(plan.bands, BAND_ROWS).T:
        keys = scramble(keys * np.uint64(31) + column)
    per_word = 64 // BITS
    low = np.zeros(-(-plan.hashes // per_word) * per_word, np.uint64)
    low[: plan.hashes] = best & np.uint64((1 << BITS) - 1)
    packed = (low.reshape(-1, per_word) << (np.arange(per_word, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64), packed.astype("<u8").tobytes()


def similarity(a: np.ndarray, b: np.ndarray, plan: Plan) -> np.ndarray:
    """Estimated Jaccard similarity of rows of packed words: equal minima, less those equal by chance."""
    differ = a ^ b
    for bit in range(1, BITS):
        differ |= (a ^ b) >> np.uint64(bit)
    ones = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    equal = 1 - np.bitwise_count(differ & ones).sum(axis=1) / plan.hashes
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def fingerprints(docs: DataFrame, plan: Plan, key: str, text: str, width: int) -> DataFrame:
    def build(columns: dict) -> dict:
        out: dict[str, list] = {n: [] for n in PRINTS.names}
        for doc, value in zip(columns["k"].to_pylist(), columns["t"]):
            value = value.as_py()
            items = shingles(value, width)
            words_key, bands, bits = b"", [], b""
            if len(items):
                words_key = xxhash.xxh3_128_digest(b" ".join(raw(value).lower().split()))
                bands, bits = signature(items, plan)
            for name, cell in zip(PRINTS.names, (doc, len(items), words_key, bands, bits)):
                out[name].append(cell)
        return out

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(
        arrow_rows(build, PRINTS), "doc_id long, n_shingles long, words_key binary, bands array<long>, bits binary")


def block_of(blocks: Column) -> Column:
    """A block of a band key's members; each key deals its members anew."""
    return F.pmod(F.xxhash64("band", "id"), blocks)


def part_of(one: Column, two: Column) -> Column:
    return F.least(one, two) * F.lit(1 << SIDE_BITS) + F.greatest(one, two)


def crowded_bands(classes: DataFrame) -> DataFrame:
    """(band, part, side, id, bits) of band keys that two classes or more share.

    Members of a key of more than ``BLOCK`` are dealt into blocks, and meet within their own.
    """
    member = classes.select(F.explode("bands").alias("band"), "id")
    counts = member.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Members of a large key meet its count in many tasks.
    counts = counts.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
    dealt = member.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(DEALS)))
    rows = dealt.join(counts, ["band", "deal"]).withColumn("side", block_of(F.ceil(F.col("n") / BLOCK)))
    rows = rows.select("band", part_of(F.col("side"), F.col("side")).alias("part"), "side", "id")
    return rows.join(classes.select("id", "bits"), "id")


def meetings(part: pa.Table, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers of pairs of classes that meet in a part and have different roots, with their estimates.

    Rows are sorted by part, and each step pairs every row with the one ``step`` rows before it.
    """
    words = -(-plan.hashes // (64 // BITS))
    band, number, side, root = (part[c].to_numpy() for c in ("band", "part", "side", "root"))
    bits = np.frombuffer(b"".join(part["bits"].to_pylist()), "<u8").reshape(-1, words)
    new = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (number[1:] != number[:-1])]))
    start = np.repeat(new, np.diff(np.append(new, len(band))))
    row, step = np.arange(len(band)), 0
    while True:
        step += 1
        row = row[row - step >= start[row]]
        if not len(row):
            return
        # In a part of two blocks, members of one block do not meet: that block has a part of its own.
        one_block = number[row] >> SIDE_BITS == number[row] & ((1 << SIDE_BITS) - 1)
        at = row[(root[row] != root[row - step]) & (one_block | (side[row] != side[row - step]))]
        if len(at):
            yield at - step, at, similarity(bits[at - step], bits[at], plan)


def best_partners(part: pa.Table, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Each member with the earlier one of its part that seems most similar, where that is similar enough."""
    best, partner = np.full(part.num_rows, plan.least), np.full(part.num_rows, -1)
    for before, at, like in meetings(part, plan):
        better = like >= best[at]
        best[at[better]], partner[at[better]] = like[better], before[better]
    at = np.flatnonzero(partner >= 0)
    return partner[at], at


def confirmed_partners(part: pa.Table, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose estimates allow it and whose full sets are similar enough, each in the first band it shares."""
    bands = np.array(part["bands"].to_pylist(), np.int64).reshape(-1, plan.bands)
    own = (bands == part["band"].to_numpy()[:, None]).argmax(axis=1)
    items = [np.frombuffer(x, "<u8") for x in part["items"].to_pylist()]
    one, two = [], []
    for before, at, like in meetings(part, plan):
        good = like >= plan.least
        before, at = before[good], at[good]
        first = (bands[before] == bands[at]).argmax(axis=1) == own[at]
        for i, j in zip(before[first].tolist(), at[first].tolist()):
            if similar(items[i], items[j], plan):
                one.append(i)
                two.append(j)
    return np.array(one, np.int64), np.array(two, np.int64)


def group_pairs(band_rows: DataFrame, plan: Plan, choose) -> DataFrame:
    """Distinct pairs (a, b) of ids that ``choose`` finds in the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            ids = part["id"].to_numpy()
            one, two = choose(part, plan)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(ids[one], ids[two])), pa.array(np.maximum(ids[one], ids[two]))], ["a", "b"])

        # Rows come sorted by part; the last part of a batch may go on in the next one.
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            band, part = held["band"].to_numpy(), held["part"].to_numpy()
            same = (band == band[-1]) & (part == part[-1])
            done = len(band) - int(same.sum())
            if done:
                yield out(held.slice(0, done))
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield out(held)

    dealt = band_rows.repartition("band", "part").sortWithinPartitions("band", "part", "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def shingle_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, items) of the wanted ids, and of a few others; texts are read once more, nothing of them shuffles.

    The filter is a bitmap of hashed ids of a fixed size. With very many ids it only lets more rows by.
    """
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bitmap = (wanted.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap")).collect())
    bits = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    # Buckets count from 1 and positions of p from p - 1; so place 0 is the lowest bit of the first bucket.
    for row in bitmap:  # at most FILTER_BITS / 32768 rows of 4 KB
        at = (row["bucket"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(row["bitmap"], np.uint8)
    shared = spark.sparkContext.broadcast(bits)
    schema = pa.schema([("id", pa.int64()), ("items", pa.binary())])

    def build(columns: dict) -> dict:
        at = columns["p"].to_numpy(zero_copy_only=False)
        chosen = np.flatnonzero(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        return {"id": columns["id"].take(pa.array(chosen)),
                "items": [shingles(columns["t"][int(i)].as_py(), width).astype("<u8").tobytes() for i in chosen]}

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).filter("id IS NOT NULL")
    return rows.withColumn("p", place).mapInArrow(arrow_rows(build, schema), "id long, items binary")


def similar(x: np.ndarray, y: np.ndarray, plan: Plan) -> bool:
    """The exact test on full sets."""
    if plan.percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= plan.percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def build(columns: dict) -> dict:
        chosen = pa.array([i for i, (x, y) in enumerate(zip(columns["x"], columns["y"])) if similar(
            np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), plan)], pa.int64())
        return {"a": columns["a"].take(chosen), "b": columns["b"].take(chosen)}

    first = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    second = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(
        arrow_rows(build, schema), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
                    width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Documents are linked when 100 * common >= percent * all shingles; a component is named by
    its smallest id, and that document is kept. A text without words is linked with nothing.
    Rows that repeat an id share a verdict. A row without an id is judged under the ids of
    its copies; alone it has no component id and is kept. Other columns are not read.
    """
    plan = Plan.of(percent)
    prints = materialize(fingerprints(docs, plan, key, text, width), "prints")
    classes = materialize(
        prints.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("words_key")
        .agg(F.min(F.struct("doc_id", "bands", "bits")).alias("first"))
        .select("words_key", F.col("first.doc_id").alias("id"), F.col("first.bands").alias("bands"),
                F.col("first.bits").alias("bits")), "classes")
    crowded = materialize(crowded_bands(classes), "crowded")
    sets = materialize(shingle_sets(docs, crowded.select("id").distinct(), key, text, width), "sets")
    sets = sets.dropDuplicates(["id"])

    alone = crowded.withColumn("root", F.col("id"))
    links = materialize(confirmed(group_pairs(alone, plan, best_partners), sets, plan), "confirmed")
    apart = joined_apart(crowded, components(links)).join(classes.select("id", "bands"), "id").join(sets, "id")
    more = materialize(group_pairs(apart, plan, confirmed_partners), "confirmed")
    roots = components(links.union(more))

    names = classes.select("words_key", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select(
        "words_key", F.coalesce("root", "id").alias("root"))
    doc, root = F.col("doc_id"), F.coalesce("root", "doc_id")
    return prints.select("doc_id", "n_shingles", "words_key").join(
        names, "words_key", "left").select("doc_id", "n_shingles", root.alias("component_id"), kept(doc, root).alias("kept"))


def kept(doc: Column, root: Column) -> Column:
    return doc.eqNullSafe(root)


def joined_apart(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, part, side, id, bits, root) of band keys in which more than one component is left.

    All pairs of members of different components meet. In a key of more than ``BLOCK`` members,
    those of its largest component are one another's already: their blocks meet only the
    blocks of the others. So rows grow with the members times the blocks of these others.
    """
    rows = crowded.select("band", "side", "id", "bits").join(
        roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = rows.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("band").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("most")).filter("roots > 1")
    # Keys and sides as in ``crowded``, so that the rows of a large key stay apart in this join.
    sides = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK) - 1))
    rows = rows.join(mixed.select("band", "n", "most", sides.alias("side")), ["band", "side"])
    large = F.col("n") > BLOCK
    major = large & (F.col("root") == F.col("most.root"))
    others = F.when(large, F.ceil((F.col("n") - F.col("most.n")) / BLOCK)).otherwise(F.lit(1))
    majors = F.when(large, F.ceil(F.col("most.n") / BLOCK)).otherwise(F.lit(0))
    side = F.when(major, others + block_of(F.greatest(majors, F.lit(1)))).otherwise(block_of(others))
    rows = rows.select(
        "band", "id", "bits", "root", side.alias("side"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.when(major, others).otherwise(others + majors) - 1)).alias("with"))
    return rows.select("band", part_of(F.col("side"), F.col("with")).alias("part"), "side", "id", "bits", "root")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each group of near-duplicates, with its own columns: that of the smallest id, rows without one last.

    Rows are judged by their text, under numbers written once; so ids may repeat or be null.
    """
    number = unused(docs, "row_number")
    docs = docs.withColumn(number, F.monotonically_increasing_id())
    rows = materialize(docs, "numbered")
    found = near_duplicates(rows, number, text, percent).select(F.col("doc_id").alias(number), "component_id")
    own = F.col(key).cast("long")
    first = F.min(F.struct(own.isNull().alias("none"), own.alias("own"), F.col(f"`{number}`").alias("row")))
    chosen = found.join(rows.select(key, number), number).groupBy("component_id").agg(first.alias("first")).select(
        F.col("first.row").alias(number))
    return rows.join(chosen, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns if c != number])
