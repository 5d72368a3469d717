"""Allow and block lists for urls: a trie over reversed host labels and path segments."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.common import fields, frame_of, with_result

#: Characters of rules that go to every task; more are joined as a table.
TRIE_CHARACTERS = 1 << 24
RESULT = ["host", "path", "rule", "verdict"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)


class Rule(NamedTuple):
    """Fits ``host`` and its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def rank(self) -> tuple[int, bool, str]:
        """The longest wins; of equals block, then the first in order of text."""
        return len(self.text), self.verdict == "block", "".join(chr(0x10FFFF - ord(c)) for c in self.text)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(FOLD), path[:stop]


class Trie:
    """Nodes are dicts: a label or segment leads on, and the other keys hold what ends there."""

    HERE, PATHS, TAILS = object(), object(), object()

    def __init__(self, rules: list[Rule]):
        self.root: dict = {}
        for number, rule in enumerate(sorted(rules, key=lambda r: r.rank)):  # later ones win
            node = self.root
            for label in reversed(rule.host.split(".")) if rule.host else []:
                node = node.setdefault(label, {})
            if not rule.path:
                node[Trie.HERE] = (number, rule)
                continue
            node = node.setdefault(Trie.PATHS, {})
            *segments, tail = rule.path.split("/")
            for segment in segments:
                node = node.setdefault(segment, {})
            node.setdefault(Trie.TAILS, {}).setdefault(len(tail), {})[tail] = (number, rule)

    def find(self, host: str, path: str) -> Rule | None:
        """The winning rule: all nodes on the way down are asked."""
        best: tuple[int, Rule] | None = None
        node: dict | None = self.root
        labels = host.split(".") if host else []
        while node is not None:
            best = max((r for r in (best, node.get(Trie.HERE)) if r), key=lambda r: r[0], default=None)
            below, rest = node.get(Trie.PATHS), path
            while below is not None:
                # Tails of one length are looked up at once, however many there are.
                for length, tails in below.get(Trie.TAILS, {}).items():
                    rule = tails.get(rest[:length])
                    if rule is not None and (best is None or rule[0] > best[0]):
                        best = rule
                segment, slash, rest = rest.partition("/")
                below = below.get(segment) if slash else None
            node = node.get(labels.pop()) if labels else None
        return best[1] if best else None


#: The last trie of this worker and the rules it is of.
_BUILT: list = [None, None]


def trie_of(rules: list[tuple]) -> Trie:
    """The trie of broadcast rules, built once a worker."""
    if _BUILT[0] is not rules:
        _BUILT[:] = [rules, Trie([Rule(*r) for r in rules])]
    return _BUILT[1]


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict), one row per row of ``pages``.

    The rules go to every task, each of whose workers builds the trie once; beyond ``TRIE_CHARACTERS`` of them they
    are joined instead, with the same result. A null url or one without ``://`` has an empty host and path. Where no
    rule fits, ``rule`` is null and the verdict is ``default``. Without rules all get it.
    """
    spark = pages.sparkSession
    if sum(len(r.text) for r in rules) > TRIE_CHARACTERS:
        return judge_joined(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), key, url, default)
    shared = spark.sparkContext.broadcast([tuple(r) for r in rules])

    @F.pandas_udf(", ".join(f"{c} string" for c in RESULT))
    def verdicts(urls: pd.Series) -> pd.DataFrame:
        trie = trie_of(shared.value)
        rows = []
        for value in urls:
            host, path = split_url(value if isinstance(value, str) else None)
            rule = trie.find(host, path)
            rows.append((host, path, rule.text if rule else None, rule.verdict if rule else default))
        return frame_of(rows, RESULT)

    return fields(with_result(pages.select(key, url), verdicts, "verdict", url), [key], RESULT)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """``split_url`` as expressions."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(F.locate("://", whole) > 0, F.regexp_replace(whole, "(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def judge_joined(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``judge`` for a table of rules (verdict, host, path) of any size, one row per row of ``pages``.

    Each url meets the rules by equality: its host suffixes with its path prefixes of the
    lengths that rules have. A suffix is tried only with lengths that rules of as many labels have, so the
    bare root of all hosts is tried only where a rule names it. Equal urls are tried once, so a hot one is one row.
    Rules with nulls fit nothing; of equal rules block wins.
    """
    many = lambda host: F.when(host == "", F.lit(0)).otherwise(F.size(F.split(host, "\\.")))
    kinds = rules.select(many(F.col("host")).alias("labels"), F.length("path").alias("size")).filter(
        "labels IS NOT NULL AND size IS NOT NULL").distinct().collect()  # as many as lengths of hosts times lengths of paths
    host, path = host_and_path(F.col(f"`{url}`"))
    parts = pages.select(F.col(f"`{key}`").alias("page"), host.alias("host"), path.alias("path"))
    tried = parts.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    meets = F.array(*[F.struct(F.lit(r["labels"]).alias("labels"), F.lit(r["size"]).alias("size")) for r in kinds])
    fits = lambda m: (m["size"] <= F.length("path")) & (m["labels"] <= many(F.col("host")))
    tail = F.when(F.col("labels") == 0, F.lit("")).otherwise(
        F.array_join(F.slice(labels, F.size(labels) - F.col("labels") + 1, F.col("labels")), "."))
    if kinds:
        tried = tried.select("host", "path", F.inline(F.filter(meets, fits))).select(
            "host", "path", tail.alias("at_host"), F.expr("substring(path, 1, size)").alias("at_path"))
    else:
        tried = tried.select("host", "path", F.lit("").alias("at_host"), F.lit("").alias("at_path"))
    rule = rules.select(F.col("host").alias("at_host"), F.col("path").alias("at_path"), "verdict")
    text = F.concat("at_host", "at_path")
    # Smallest first: the longest, then block, then the text.
    order = F.struct(-F.length(text), F.col("verdict") != "block", text.alias("rule"), "verdict")
    won = tried.join(rule, ["at_host", "at_path"]).groupBy("host", "path").agg(F.min(order).alias("won"))
    return parts.join(won, ["host", "path"], "left").select(F.col("page").alias(key), "host", "path", F.col("won.rule").alias("rule"), F.coalesce(
        "won.verdict", F.lit(default)).alias("verdict"))
