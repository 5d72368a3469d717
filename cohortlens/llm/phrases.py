"""Phrases that hold together, found by best-first branch-and-bound growth.

Phrases grow word by word from their prefixes. A candidate is a phrase of two words or more with
count a >= ``LEAST``; it scores floor(10^6 a^2 / (l r)) at its lowest-scoring cut into l and r.
Two bounds follow from counts of prefixes alone, and neither drops a phrase that could matter:

* a phrase occurs no oftener than any part of it, so only positions where both shorter parts
  are frequent are counted;
* with a prefix of count c and first word of count f, a longer phrase has a <= c and r >= a at
  the cut after its first word, so it scores at most 10^6 c / f.

The frontier of each language opens best bound first, as far as the score of its ``2 * limit``-th
candidate; what could drop one of the candidates above that score is counted as well. If fewer than
``limit`` of them survive, the language opens twice as many and goes on, down to the last phrase. At
the end every candidate at or above the score is known, with its survival: the order is settled,
ties included.

Sets of phrases reach the tasks as bitmaps of fixed size. A hash that falls on another's bit only
has a phrase counted in vain, and every phrase counted is counted everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm.common import raw, scramble, windows
from cohortlens.session import materialize

LONGEST, LEAST, LIMIT = 3, 10, 2000
#: Shares, in percent, from which a longer candidate drops those inside it.
COVERED = 50
#: Bits of a set of phrases (4 MB, whatever the input).
SET_BITS = 1 << 25
BUCKET = 1 << 15
#: Words that a task looks at together, distinct words among them, and phrases it sends on at a time.
TOGETHER, KNOWN_WORDS, SENT = 1 << 21, 1 << 18, 1 << 16
UNKNOWN = "und"
BREAK = b"\n"
#: A-Z to a-z, marks that end a piece to line feeds, tabs to spaces.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


class Words(dict):
    """Numbers of words in the order they come up, with their spellings and hashes."""

    def __init__(self) -> None:
        super().__init__()
        self.spelled, self.hashes = [], []
        self[BREAK]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.spelled)
        self.spelled.append(word.decode("utf-8", "replace"))
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return number


def tokens(text: str | None) -> list[bytes]:
    """Words, and a break at the end of each piece."""
    folded = raw(text).translate(FOLD).replace(BREAK, b" \n ") + b" \n"
    return list(filter(None, folded.split(b" ")))


def places(words: np.ndarray, lang: str, width: int) -> np.ndarray:
    """The bit of each run of ``width`` words."""
    own = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    return (scramble(windows(words, width) ^ own) % np.uint64(SET_BITS)).astype(np.int64)


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def phrase_set(phrases: DataFrame, width: int):
    """Broadcast bitmap of a table (lang, phrase) of phrases of ``width`` words."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [places(np.array([xxhash.xxh3_64_intdigest(w) for w in phrase.encode().split(b" ")], np.uint64), lang, width)[0]
                   for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["p"])

    found = phrases.select("lang", "phrase").mapInArrow(place, "p long").select((F.col("p") + 1).alias("p"))
    rows = found.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    bits = np.zeros(SET_BITS // 8, np.uint8)
    for row in rows:  # at most SET_BITS / 32768 rows of 4 KB
        at = (row["bucket"] - 1) * (BUCKET // 8)
        bits[at : at + BUCKET // 8] = np.frombuffer(row["bits"], np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(bits)


def counted_rows(lang: str, phrases: list[str | None], numbers: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()),
                                       pa.array(numbers.astype(np.int64))], schema=COUNTS)


def counted(docs: DataFrame, width: int, frequent=None, grown=None, contended=None) -> DataFrame:
    """(lang, phrase, n) of all runs of ``width`` words inside pieces, counted over all of ``docs``.

    With sets of phrases one word shorter: only runs whose two shorter parts are ``frequent``, and of
    which the first is to be ``grown`` or one of them is ``contended``. Single words come with one
    row a language whose phrase is null: all its word occurrences.
    """

    def positions(ids: np.ndarray, hashes: np.ndarray, lang: str) -> np.ndarray:
        count = len(ids) - width + 1
        keep = np.ones(max(count, 0), bool)
        for i in range(width):
            keep &= ids[i : i + count] != 0
        if frequent is not None and count > 0:
            at = places(hashes[ids], lang, width - 1)
            first, last = at[:-1], at[1:]
            keep &= has(frequent.value, first) & has(frequent.value, last)
            if grown is not None:
                keep &= has(grown.value, first) | has(contended.value, first) | has(contended.value, last)
        return np.flatnonzero(keep)

    def folded(ids: np.ndarray, table: Words, lang: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each distinct phrase first stands and how often it occurs; equal numbers are equal words, so nothing is mixed up."""
        at = positions(ids, np.array(table.hashes, np.uint64), lang)
        key, room = ids[at].astype(np.int64), len(table)
        for i in range(1, width):
            if room * len(table) >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1]
                room = len(at)
            key = key * len(table) + ids[at + i]
            room *= len(table)
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        return at[first], counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, read = Words(), {}, 0

        def let_go() -> Iterator[pa.RecordBatch]:
            spelled = np.array(table.spelled, object)
            for lang in list(held):
                ids = np.concatenate(held.pop(lang))
                if width == 1:
                    numbers = np.bincount(ids, minlength=len(table))
                    numbers[0] = 0
                    total = numbers.sum()
                    at = np.flatnonzero(numbers)
                    numbers = numbers[at]
                    spell = lambda part: spelled[part].tolist()
                    if total:
                        yield counted_rows(lang, [None], np.array([total]))
                else:
                    at, numbers = folded(ids, table, lang)
                    spell = lambda part: [" ".join(w) for w in zip(*(spelled[ids[part + i]] for i in range(width)))]
                # Spelled a part at a time.
                for start in range(0, len(at), SENT):
                    yield counted_rows(lang, spell(at[start : start + SENT]), numbers[start : start + SENT])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = tokens(text.as_py())
                held.setdefault(lang, []).append(np.fromiter(map(table.__getitem__, words), np.int32, len(words)))
                read += len(words)
                if read >= TOGETHER or len(table) >= KNOWN_WORDS:
                    yield from let_go()
                    table, held, read = Words(), {}, 0
        yield from let_go()

    rows = docs.mapInArrow(run, "lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def words_of(phrase: Column, first: int, last: int | None = None) -> Column:
    """Words ``first`` to ``last`` of a phrase, both counted from 1."""
    parts = F.split(phrase, " ")
    length = F.size(parts) - (first - 1) if last is None else F.lit(last - first + 1)
    return F.array_join(F.slice(parts, first, length), " ")


def at_cut(together: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (l r)), exact for counts below 10^16."""
    whole = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole(together) * whole(together)),
                           (whole(left) * whole(right))).cast("long")


def scored(grams: dict[int, DataFrame], width: int) -> DataFrame:
    """(lang, phrase, a, l, r, score, first) of phrases of ``width`` words; ``first`` counts the first word."""
    rows = grams[width].withColumnRenamed("n", "a")
    cuts = []
    for cut in range(1, width):
        sides = {"l": (words_of(F.col("phrase"), 1, cut), cut), "r": (words_of(F.col("phrase"), cut + 1), width - cut)}
        for side, (part, size) in sides.items():
            other = grams[size].select("lang", F.col("phrase").alias("part"), F.col("n").alias(f"{side}{cut}"))
            rows = rows.withColumn("part", part).join(other, ["lang", "part"]).drop("part")
        cuts.append(F.struct(at_cut(F.col("a"), F.col(f"l{cut}"), F.col(f"r{cut}")).alias("score"), F.lit(cut).alias("cut"),
                             F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))
    # The least struct: lowest score, then smallest cut.
    lowest = F.array_min(F.array(*cuts))
    return rows.withColumn("w", lowest).select(
        "lang", "phrase", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), F.col("w.score").alias("score"),
        F.col("l1").alias("first"))


def dropped_by(longer: DataFrame, width: int) -> DataFrame:
    """(lang, phrase, above): the largest count of a longer candidate around each phrase of ``width`` words."""
    parts = F.array(words_of(F.col("phrase"), 1, width), words_of(F.col("phrase"), 2))
    return longer.select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), F.col("n").alias("above")).groupBy(
        "lang", "phrase").agg(F.max("above").alias("above"))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", limit: int = LIMIT, longest: int = LONGEST,
         least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``limit`` surviving phrases of 2 to ``longest`` words.

    Texts are split into pieces at ``.,;:!?`` and line ends, and these into words at spaces and tabs; A-Z
    are lower-cased. A null text counts as empty, a null language as ``und``; repeated rows count each
    time. Order: score and count descending, then the phrase by its UTF-8 bytes, which settles all ties.
    A phrase inside a longer candidate with at least ``covered`` percent of its count is dropped. Empty
    tables give no rows, and other columns of ``docs`` are not read.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    singles = materialize(counted(rows, 1), "words")
    totals = singles.filter("phrase IS NULL").select("lang", "n")
    grams = {1: singles.filter(F.col("phrase").isNotNull() & (F.col("n") >= least))}
    # All frequent phrases but the longest, whose growth is bounded.
    for width in range(2, longest):
        longer = counted(rows, width, phrase_set(grams[width - 1], width - 1))
        grams[width] = materialize(longer.filter(F.col("n") >= least), "phrases")
    shorter = None
    for width in range(2, longest):
        known = scored(grams, width).withColumn("width", F.lit(width))
        if width < longest - 1:
            known = uncovered(known, grams[width + 1], width, covered)
        shorter = known if shorter is None else shorter.unionByName(known)
    best, opened = None, 2 * limit
    if shorter is None:
        grams[2] = materialize(counted(rows, 2, phrase_set(grams[1], 1)).filter(F.col("n") >= least), "phrases")
        best = scored(grams, 2).drop("first")
    else:
        shorter = materialize(shorter, "scores")
        frequent = phrase_set(grams[longest - 1], longest - 1)
    while shorter is not None:
        settled, todo = branch(rows, grams, shorter, frequent, opened, limit, longest, least, covered)
        best = settled if best is None else best.unionByName(settled)
        if todo is None:
            break
        rows, shorter = rows.join(todo, "lang", "left_semi"), shorter.join(todo, "lang", "left_semi")
        opened *= 2
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def uncovered(candidates: DataFrame, longer: DataFrame, width: int, covered: int) -> DataFrame:
    """Candidates of ``width`` words without those inside a ``longer`` one of at least ``covered`` percent of their count.

    One word longer is enough to look at: what lies between a phrase and a still longer one occurs no
    less often than the latter.
    """
    kept = candidates.join(dropped_by(longer, width), ["lang", "phrase"], "left")
    return kept.filter(F.col("above").isNull() | (F.col("above") * 100 < F.col("a") * covered)).drop("above")


def branch(rows: DataFrame, grams: dict[int, DataFrame], shorter: DataFrame, frequent, opened: int, limit: int, longest: int,
           least: int, covered: int) -> tuple[DataFrame, DataFrame | None]:
    """Survivors at or above the score of each language's ``opened``-th shorter phrase, and the languages that need more."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"))
    # A language with fewer is opened whole.
    levels = materialize(shorter.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= opened).groupBy("lang").agg(
        F.when(F.max("rank") == opened, F.min("score")).otherwise(0).alias("level")), "levels")
    open_ones = shorter.join(levels, "lang")
    above = open_ones.filter(F.col("score") >= F.col("level"))
    prefixes, contended = open_ones.filter(F.col("width") == longest - 1), above.filter(F.col("width") == longest - 1)
    # Bound of all that grows from a prefix, from its count and that of its first word.
    bound = F.col("a") * F.lit(1_000_000).cast("decimal(7,0)") >= F.col("level") * F.col("first").cast("decimal(20,0)")
    longer = counted(rows, longest, frequent, phrase_set(prefixes.filter(bound), longest - 1), phrase_set(contended, longest - 1))
    last = materialize(longer.filter(F.col("n") >= least), "longest")
    names = ["lang", "phrase", "a", "l", "r", "score"]
    grown = scored({**grams, longest: last}, longest).join(levels, "lang").filter(F.col("score") >= F.col("level"))
    kept = above.filter(F.col("width") < longest - 1).select(*names).unionByName(
        uncovered(contended, last, longest - 1, covered).select(*names)).unionByName(grown.select(*names))
    survivors = materialize(kept, "survivors")
    found = survivors.groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
    short = materialize(levels.join(found, "lang", "left").filter(
        (F.col("level") > 0) & (F.coalesce("found", F.lit(0)) < limit)).select("lang"), "short")
    return survivors.join(short, "lang", "left_anti"), None if short.isEmpty() else short
