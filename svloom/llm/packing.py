"""Cost-balanced packing of tokenized documents into sequences of a fixed capacity.

Attention makes a piece of n tokens cost n + QUADRATIC * n^2. A document longer than the capacity gives full
sequences of its own; what is left of it, and every shorter document, is assigned in order of descending cost to
the sequence of the lowest cost that has room for it. What fits nowhere whole is cut over the sequences with
room left, lowest cost first. A packing group of T tokens has floor(T / capacity) full sequences; its last
T % capacity tokens go into sequences whose lengths are the powers of two that add up to it, so that nothing is
padded. Groups are consecutive documents of about GROUP_TOKENS tokens of one input split: packing needs no
shuffle, holds one group in memory and is the same after a lost task, whose split is read again.

Null and empty texts have no ids of their own but the end mark. Rows are packed one by one: repeated rows are
packed repeatedly; extra columns are not read; an empty table gives no piece. A null doc_id passes through. A long document's
text and ids are held whole by its task.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from svloom.llm import bytewords as bw
from svloom.llm.shared import release_memory

CAPACITY = 2048
#: Weight of the quadratic part: attention over n tokens costs as much as everything else at n = 1 / QUADRATIC.
QUADRATIC = 1 / 1024
END_ID = 1
GROUP_TOKENS = 2_000_000
#: Words, and parts of words, whose ids a worker remembers, and their bytes.
CACHED_WORDS, CACHED_BYTES = 150_000, 1 << 24
#: Bytes of texts that are tokenized at once.
BATCH_BYTES = 1 << 21
#: Pieces of one Arrow batch of results: 2 MB of ids at most.
BATCH_PIECES = 256


#: Latin letters, of which lower case and composition are plain, with punctuation after them: two pieces at most.
PLAIN = "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)(?P<after>[.,;:!?#$%&*|]*)$"
_shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
#: Byte-level pieces show each byte as one character: printable ones as themselves, the others from U+0100 on.
SHOWN = {b: chr(b) for b in _shown} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_shown}))}


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Memory:
    """Distinct strings with their ids, as arrays. When full it drops those that were met in one batch only; if that is not enough, all."""

    def __init__(self):
        self.strings, self.starts, self.flat, self.met = pa.array([], pa.large_string()), np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def full(self, share: int = 1) -> bool:
        return len(self.strings) * share > CACHED_WORDS or self.strings.nbytes * share > CACHED_BYTES

    def thin(self) -> None:
        kept = np.flatnonzero(self.met > 1)
        at, n = self.starts[kept], self.starts[kept + 1] - self.starts[kept]
        self.strings, self.flat, self.starts = self.strings.take(pa.array(kept)), self.flat[spans(at, n)], np.concatenate([[0], np.cumsum(n)])
        self.met = np.ones(len(kept), np.int32)
        if self.full(2):
            self.__init__()

    def slots(self, strings: pa.Array, spell) -> np.ndarray:
        """Place of each of these distinct strings; ``spell`` gives the ids of new ones and their number for each."""
        if self.full():
            self.thin()
        at = pc.index_in(strings, value_set=self.strings)
        slots = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.met[slots[slots >= 0]] += 1
        if at.null_count:
            fresh = strings.filter(at.is_null())
            flat, n = spell(fresh)
            slots[slots < 0] = np.arange(len(self.met), len(self.met) + len(fresh))
            self.strings, self.flat = pa.concat_arrays([self.strings, fresh]), np.concatenate([self.flat, flat])
            self.starts, self.met = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n)]), np.concatenate([self.met, np.ones(len(fresh), np.int32)])
        return slots


class WordTokenizer:
    """Ids of whole texts by the ``tokenizers`` library, each distinct word or part tokenized once while it is remembered.

    The tokenizer's pieces never span white space, so a text's ids are those of its blank-separated words
    in order. A plain word's are those of its lower-cased letters and of the punctuation after them. Words and
    letters are told apart as strings (Arrow's dictionary encoding), not by a hash.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.words, self.parts = Memory(), Memory()
        self.pieces: dict[str, list[int]] = {}

    def _ids(self, word: str) -> list[int]:
        """Ids of a word that isn't plain."""
        t = self.tokenizer
        if any(s in word for s in self.special):
            return t.encode(word, add_special_tokens=False).ids
        out: list[int] = []
        for part, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(word)):
            got = self.pieces.get(part)
            if got is None:
                got = [x.id for x in t.model.tokenize(part)]
                if len(part) <= 3 and len(self.pieces) < CACHED_WORDS:
                    self.pieces[part] = got
            out += got
        return out

    def _spell_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        tokenize, flat, n = self.tokenizer.model.tokenize, array("I"), []
        for part in parts.to_pylist():
            ids = [x.id for x in tokenize(part if part.isascii() else "".join(map(SHOWN.__getitem__, part.encode())))] if part else []
            flat.extend(ids)
            n.append(len(ids))
        return np.array(flat, np.uint32), np.array(n, np.int64)

    def _spell_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.extract_regex(words, PLAIN)
        plain = split.is_valid()
        for s in self.special:
            plain = pc.and_not(plain, pc.match_substring(words, s))
        split, plain = split.filter(plain), plain.to_numpy(zero_copy_only=False)
        parts = pa.concat_arrays([pc.utf8_lower(split.field("letters")), split.field("after")]).dictionary_encode()
        slots = self.parts.slots(parts.dictionary, self._spell_parts)[parts.indices.to_numpy()]
        others = [self._ids(w) for w in words.filter(pa.array(~plain)).to_pylist()]
        # a word that isn't plain has its ids behind those of the parts, and nothing after them
        starts, sizes = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        known = self.parts.starts
        starts[plain], sizes[plain] = known[slots].reshape(2, -1).T, (known[slots + 1] - known[slots]).reshape(2, -1).T
        sizes[~plain, 0] = n = np.array([len(x) for x in others], np.int64)
        starts[~plain, 0] = known[-1] + np.cumsum(n) - n
        flat = np.concatenate([self.parts.flat, np.array([i for x in others for i in x], np.uint32)])
        return flat[spans(starts.ravel(), sizes.ravel())], sizes.sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the n + 1 offsets of the texts in them."""
        words = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        each = self.words.slots(coded.dictionary, self._spell_words)[coded.indices.to_numpy(zero_copy_only=False)]
        at = self.words.starts[each]
        n = self.words.starts[each + 1] - at
        ends = np.concatenate([[0], np.cumsum(n)])
        offsets = words.offsets.to_numpy()
        return self.words.flat[spans(at, n)], ends[offsets - offsets[0]]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer a worker process, with what it remembers."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of documents of these lengths; sequences from 0."""
    out, rest = [], []
    sequence = 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            out.append((d, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, d, n - n % capacity))
    total = sum(n for n, _, _ in rest)
    sizes = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if total % capacity >> b & 1]
    room, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    rest.sort(key=lambda x: (-x[0], x[1]))
    cut = []

    def put(n: int, d: int, start: int, s: int) -> None:
        out.append((d, start, n, sequence + s, sizes[s] - int(room[s])))
        room[s] -= n
        cost[s] += n + QUADRATIC * n * n

    for n, d, start in rest:
        fits = room >= n
        s = int(np.where(fits, cost, np.inf).argmin())
        if fits[s]:
            put(n, d, start, s)
        else:
            cut.append((n, d, start))
    open_ = [(float(cost[s]), s) for s in np.flatnonzero(room).tolist()]
    heapq.heapify(open_)
    for n, d, start in cut:
        while n:
            s = open_[0][1]
            some = min(n, int(room[s]))
            put(some, d, start, s)
            n, start = n - some, start + some
            if room[s]:
                heapq.heapreplace(open_, (float(cost[s]), s))
            else:
                heapq.heappop(open_)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the token ids."""

    def flush(group: list, base: int, first: int) -> Iterator[pa.RecordBatch]:
        ids = [x for _, x in group]
        pieces = pack([len(x) for x in ids], capacity)
        for at in range(0, len(pieces), BATCH_PIECES):
            some = pieces[at : at + BATCH_PIECES]
            cols = list(zip(*some))
            tokens = [ids[d][a : a + n] for d, a, n, _, _ in some]
            arrays = [
                pa.array([group[d][0] for d in cols[0]], pa.int64()),
                pa.array(cols[1], pa.int64()),
                pa.array(cols[2], pa.int64()),
                pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in tokens], pa.int64()),
                pa.array([len(ids[d]) for d in cols[0]], pa.int64()),
                pa.array([base + first + s for s in cols[3]], pa.int64()),
                pa.array(cols[4], pa.int64()),
            ]
            if with_ids:
                arrays.append(pa.array([t.astype(np.int32) for t in tokens], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        return first + 1 + max(s for _, _, _, s, _ in pieces)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release_memory()
        base, first, held = TaskContext.get().partitionId() << 33, 0, 0
        tokenizer, group = tokenizer_of(tokenizer_path), []
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in bw.slices(texts, BATCH_BYTES):
                ids, at = tokenizer.encode(texts.slice(a, b - a))
                for i in range(b - a):
                    group.append((keys[a + i], np.append(ids[at[i] : at[i + 1]], np.uint32(END_ID))))
                    held += len(group[-1][1])
                    if held >= group_tokens:
                        first = yield from flush(group, base, first)
                        group, held = [], 0
        if group:
            yield from flush(group, base, first)
        del group
        release_memory()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(apply, schema)
