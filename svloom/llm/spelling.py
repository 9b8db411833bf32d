"""Spelling variants: Aho-Corasick automata over word halves find all words that differ by one edit.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased. The contract's damage is part of the input:
where 97 divides the crc32 h of ``<doc_id>:<run>``, the run's code point h % length is deleted. Counted are results of
at least MIN_LENGTH code points; those with at least MIN_COUNT occurrences are words.

A word is cut into two halves. Of two words that differ by one inserted, deleted or replaced code point, each has a half
that the edit spares: it stands in the other word at offset 0 (first half) or ends where that word ends (second half),
and the lengths differ by one at most. The dictionary is dealt to shards of one word length and SHARD_CHARS characters
at most; a shard's automaton holds both halves of each of its words. Every word is scanned by all shards of its own
length and the two next to it; hits at any other offset are passed over, the others are verified letter by letter, all
pairs of a batch together. Of halves beyond KEY characters the automaton holds the first KEY, which is a condition
that the halves imply; verification always sees whole words. No list of candidates is cut.

Null and empty texts have no runs; a null doc_id counts as an empty one in ``<doc_id>:<run>``. A text without gaps
is one run, however long, and is held whole with its postings. Repeated rows count again. Empty tables give empty results.
Extra columns are not read. Ties of n go to the smallest word in code-point order.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from svloom.llm.shared import Workspace, release_memory, with_small_side

DAMAGE, MIN_LENGTH, MIN_COUNT = 97, 5, 3
SHARD_CHARS, KEY = 1 << 18, 64
#: Distinct words that a task counts before it sends them on; letters of candidate pairs that are compared at once.
HELD, AT_ONCE = 200_000, 1 << 24
_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the results with at least MIN_LENGTH code points and MIN_COUNT occurrences in ``docs`` (doc_id, text)."""

    def apply(batches):
        counts: dict[str, int] = {}

        def sent():
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return rows

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if (text := text.as_py()) is None:
                    continue
                id_crc = crc32(f"{'' if (x := doc_id.as_py()) is None else x}:".encode())
                for word, n in Counter(_RUN.findall(text.encode().translate(_LOWER).decode())).items():
                    h = crc32(word.encode(), id_crc)
                    if h % DAMAGE == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    if len(word) >= MIN_LENGTH:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) >= HELD:
                    yield sent()
        yield sent()
        release_memory()

    parts = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(apply, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def is_near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` and ``b`` (letters; widths differ by one at most) differ by exactly one edit."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    short = min(a.shape[1], b.shape[1])

    def common(x, y):
        differ = np.concatenate([x != y, np.ones((len(x), 1), bool)], 1)
        return differ.argmax(1)

    return common(a[:, :short], b[:, :short]) + common(a[:, ::-1][:, :short], b[:, ::-1][:, :short]) >= short


def _letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


class Shard:
    """Automaton over the halves of words of one length."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n, self.length = words, np.array(n, np.int64), len(words[0])
        order = np.argsort(np.array(words, object), kind="stable")
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        self.letters = _letters(words, self.length)
        half, postings = self.length // 2, {}
        for i, word in enumerate(words):
            postings.setdefault(word[:half][:KEY], ([], []))[0].append(i)
            postings.setdefault(word[half:][:KEY], ([], []))[1].append(i)
        self.automaton = ahocorasick.Automaton()
        for key, lists in postings.items():
            self.automaton.add_word(key, (len(key), *(np.array(x, np.int64) for x in lists)))
        self.automaton.make_automaton()

    def candidates(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``words``, word of this shard) where a half stands at its offset; ``words`` are of one length."""
        length, second = len(words[0]), len(words[0]) - (self.length - self.length // 2)
        spans = [(0, length)] if length <= 4 * KEY else [(0, KEY), (second, second + KEY)]
        rows, lists = [], []
        for row, word in enumerate(words):
            for a, b in spans:
                for end, (size, at_start, at_end) in self.automaton.iter(word, a, b):
                    start = end - size + 1
                    if start == 0 and len(at_start):
                        rows.append(row), lists.append(at_start)
                    if start == second and len(at_end):
                        rows.append(row), lists.append(at_end)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        mine, theirs = np.repeat(rows, [len(x) for x in lists]), np.concatenate(lists)
        return mine, theirs

    def near(self, words: list[str]):
        """(row of ``words``, number of near words here, their largest n, the first word with it) of rows with any."""
        mine, theirs = self.candidates(words)
        letters, good = _letters(words, len(words[0])), []
        step = max(1, AT_ONCE // self.length)
        for a in range(0, len(mine), step):
            good.append(is_near(letters[mine[a : a + step]], self.letters[theirs[a : a + step]]))
        good = np.concatenate([np.zeros(0, bool), *good])
        pairs = np.unique(mine[good] * len(self.words) + theirs[good])  # a pair may share both halves
        mine, theirs = pairs // len(self.words), pairs % len(self.words)
        order = np.lexsort((self.rank[theirs], -self.n[theirs], mine))
        mine, theirs = mine[order], theirs[order]
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        return mine[first], np.diff(np.append(first, len(mine))), self.n[theirs[first]], [self.words[i] for i in theirs[first]]


def near_words(ws: Workspace, words: DataFrame) -> DataFrame:
    """(word, n_near, best) of the words of ``words`` (word, n) with any near word; best: least of (-n, word) among them."""
    spark = ws.spark
    words = words.select(F.length("word").alias("size"), "word", "n")
    lengths = words.groupBy("size").agg(F.ceil(F.count(F.lit(1)) * F.col("size") / SHARD_CHARS).cast("int").alias("parts"))
    lengths = ws.table(lengths, "lengths")
    lengths = with_small_side(spark, lengths, lengths.count())
    kept = words.join(lengths, "size").select(F.col("size").alias("length"), F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("size"), "word", "n")
    asked = words.select("size", "word", F.explode(F.array(*[F.col("size") + d for d in (-1, 0, 1)])).alias("length"))
    asked = asked.join(lengths.withColumnRenamed("size", "length"), "length")
    asked = asked.select("length", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "size", "word", F.lit(None).cast("long").alias("n"))

    def apply(batches):
        """Of each shard first come its own words (size 0), then the words to scan, by size."""
        at, own, shard = None, ([], []), None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            found = []
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if a == b:
                    continue
                if at != (key := tuple(keys[a, :2])):
                    at, own, shard = key, ([], []), None
                names = batch.column(3).slice(a, b - a).to_pylist()
                if keys[a, 2] == 0:
                    own[0].extend(names), own[1].extend(batch.column(4).slice(a, b - a).to_pylist())
                    continue
                if not own[0]:
                    continue  # no word fell into this part
                shard = shard or Shard(*own)
                rows, count, n, best = shard.near(names)
                found.append(([names[i] for i in rows], count, n, best))
            if found:
                names, best = [x for f in found for x in f[0]], [x for f in found for x in f[3]]
                count, n = (np.concatenate([f[k] for f in found]) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(count), pa.array(n), pa.array(best, pa.string())], names=["word", "count", "n", "best"])
        release_memory()

    dealt = kept.unionByName(asked).repartition("length", "part").sortWithinPartitions("length", "part", "size")
    met = dealt.mapInArrow(apply, "word string, count long, n long, best string")
    return met.groupBy("word").agg(F.sum("count").alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), F.col("best").alias("word"))).alias("best"))


def roots(ws: Workspace, forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last word that forms lead to; rounds double the steps taken."""
    now = ws.table(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = ws.table(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ws.drop(now)
        now = after
    return now.select("word", "root")


def variant_groups(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of ``docs`` (doc_id, text).

    form: the near word of largest n, if that is at least twice the word's own; else null. root: where forms lead.
    The result reads tables of ``ws``, which the caller may clear when it is done with it.
    """
    ws = ws or Workspace(docs.sparkSession, "spelling")
    words = ws.table(word_counts(docs), "words")
    near = words.join(near_words(ws, words), "word", "left")
    leads = -F.col("best.minus") >= 2 * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best.word")).alias("form"), F.when(leads, -F.col("best.minus")).alias("form_n"))
    near = ws.table(near, "near")
    found = near.join(roots(ws, near.where("form is not null")), "word", "left")
    return found.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
