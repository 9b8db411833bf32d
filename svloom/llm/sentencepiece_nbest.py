"""SentencePiece encoding and decoding by N-best search over the piece lattice.

The lattice of a text has an edge for each vocabulary piece that matches somewhere. A forward Viterbi pass gives
each position the best score from the start; a backward A-star search from the end uses these as its exact
heuristic, so complete paths leave its queue in order of score. Each queued partial path completes at exactly the
score it is queued with, and no two of them share a path; so only the n best have to stay in the queue, and of
equal ones that which has come nearest to the start goes on. A search therefore takes n steps a piece at most,
however many paths tie, and remembers 8 bytes a character and the n paths. Ties go to the path whose last piece is
longer. Characters that no piece covers become UTF-8 byte pieces at a score below all others.

Weights are whole numbers (units of 1 / SCALE), so sums are exact in any order. A model whose scores are whole
numbers is a BPE model, which orders its pieces by rank; by Zipf's law the piece of rank r weighs -log(r + ZIPF).
Other models' scores are log-probabilities already.

Before that, as the model's normalizer says, one blank is put in front of a non-empty text and blanks become ▁.
A lattice falls into parts wherever no piece of the vocabulary holds the two neighbouring characters; a piece has ▁
at its beginning only, so one such place is before each run of ▁: a unit is what follows it. A text's best path is
that of its parts. Each worker remembers the best path of the units and parts it has met and what the second
loses, as they repeat much, and all N paths of those that needed them. A text's N best paths are merged from them
by a lazy heap over what its units lose: only the N - 1 units whose second path loses least can differ from their
best one (of equal losses, the earlier units). Each of a text's paths is decoded as a whole to tell whether it
gives the text again.

Null counts as empty; an empty text has no pieces, scores 0 and no second path. A literal ▁ decodes as a blank:
round_trip tells. A long text, or a long run without blanks, is searched whole. ``decode_documents`` turns ids into
texts. Rows are encoded one by one; repeated rows repeat; other columns are not read; an empty table is empty.
"""

from __future__ import annotations

import heapq
import math
import zlib
from array import array
from bisect import insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from svloom.llm import bytewords as bw

BLANK = "▁"
#: Units of a weight in the lattice, and what is added to the rank of a BPE piece.
SCALE, ZIPF = 1 << 20, 100.0
#: Below the worst piece by so much: a character spelled in bytes.
BYTE_LOSS = 10.0
#: What a worker remembers at most: units, and ids of their paths.
CACHED_UNITS, CACHED_IDS = 1_500_000, 12_000_000
CACHED_DEEP = 2_000_000
#: Parts of up to so many characters are searched forwards only, with more memory a character; bytes of texts that are encoded at once.
SHORT, BATCH_BYTES = 4096, 1 << 20
#: Paths of a document.
N_BEST = 4
LOW, NO_LOSS = -(1 << 62), 1 << 62


def least_sums(losses: list[list[int]], n: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The ``n`` smallest (sum, [(list, place)]) of one value from each list, as far as places aren't 0.

    Each list ascends from 0 and has two values or more; the lists ascend by their second value.
    """
    out, tick, queue = [(0, [])], 0, [(losses[0][1], 0, [(0, 1)])] if losses else []
    while queue and len(out) < n:
        got = heapq.heappop(queue)
        out.append((got[0], got[2]))
        before, (j, k) = got[2][:-1], got[2][-1]
        after = [before + [(j, k + 1)]] if k + 1 < len(losses[j]) else []
        if j + 1 < len(losses):
            after += [got[2] + [(j + 1, 1)]] + ([before + [(j + 1, 1)]] if k == 1 else [])
        for moves in after:
            tick += 1
            heapq.heappush(queue, (sum(losses[a][b] for a, b in moves), tick, moves))
    return out


class Pieces:
    """Vocabulary of a model file; its own segmentation isn't used."""

    def __init__(self, path: str, n: int = N_BEST):
        import sentencepiece

        self.n = n
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in ids]
        self.bytes = {int(self.text[i][3:5], 16): i for i in ids if model.is_byte(i)}
        #: What each id decodes to; control pieces to nothing.
        self.raw = [b"" if model.is_control(i) else self.text[i].replace(BLANK, " ").encode() for i in ids]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.spelled = pa.array(self.raw, pa.large_binary())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        if any(BLANK in self.text[i].lstrip(BLANK) for i in plain):
            raise ValueError(f"{path} has pieces with {BLANK} behind other characters")
        weight = [model.get_score(i) for i in plain]
        if all(w.is_integer() for w in weight):
            weight = [-math.log(rank + ZIPF) for rank in range(len(plain))]
        self.score = {self.text[i]: (round(w * SCALE), i) for i, w in zip(plain, weight)}
        #: All pieces with (weight, number), and all their beginnings that are no pieces with None.
        self.known = {p[:k]: None for p in self.score for k in range(1, len(p) + 1)} | self.score
        #: The same as a tree: by character (weight or None, number, children).
        nodes: dict[str, dict] = {"": {}}
        for p in sorted(self.known, key=len):
            nodes[p] = {}
            nodes[p[:-1]][p[-1]] = (*(self.known[p] or (None, -1)), nodes[p])
        self.tree = nodes[""]
        self.joined = {pair for p in self.score for pair in zip(p, p[1:])}
        self.endings = {p[k:] for p in self.score for k in range(len(p))}
        self.unknown = min(w for w, _ in self.score.values()) - round(BYTE_LOSS * SCALE)
        self.forget()

    def forget(self) -> None:
        self.units: dict[str, int] = {}
        self.known_parts: dict[str, int] = {}
        #: Of each unit and part the ids and score of its best path, and what the second path loses.
        self.starts, self.ids = array("q", [0]), array("i")
        self.best, self.loss = array("q"), array("q")
        #: By unit, all N paths.
        self.more: dict[str, list[tuple[int, np.ndarray]]] = {}
        self.held = 0

    def forward(self, text: str) -> array:
        """Best score from the start to each position."""
        n, known, unknown = len(text), self.known, self.unknown
        alpha = array("q", [LOW]) * (n + 1)
        alpha[0] = 0
        for s in range(n):
            at, e = alpha[s], s + 1
            got = known.get(text[s:e], 0)
            if not got and at + unknown > alpha[e]:
                alpha[e] = at + unknown
            while got != 0:
                if got and at + got[0] > alpha[e]:
                    alpha[e] = at + got[0]
                e += 1
                if e > n:
                    break
                got = known.get(text[s:e], 0)
        return alpha

    def backward(self, text: str, e: int) -> list[tuple[int, int, int]]:
        """Edges (start, weight, piece or -1) that end at ``e``."""
        out, s = [], e - 1
        while s >= 0 and (part := text[s:e]) in self.endings:
            if got := self.score.get(part):
                out.append((s, *got))
            s -= 1
        if not out or out[0][0] != e - 1:
            out.append((e - 1, self.unknown, -1))
        return out

    def nbest(self, text: str, n: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """The ``n`` best (score, path) of a text whose blanks are ▁; a path has (start, end, piece or -1) from left to right."""
        alpha, out, tick, room = self.forward(text), [], 0, n
        queue = [(-alpha[-1], len(text), 0, 0, None)]
        while queue and room:
            _, at, _, after, path = queue.pop(0)
            if at == 0:
                steps = []
                while path:
                    step, path = path
                    steps.append(step)
                out.append((after, steps))
                room -= 1
                continue
            for s, w, i in self.backward(text, at):
                tick += 1
                cost = -(alpha[s] + w + after)
                if len(queue) >= room:
                    if (cost, s) >= queue[-1][:2]:
                        continue
                    queue.pop()
                insort(queue, (cost, s, tick, after + w, ((s, at, i), path)))
        return out

    def best_two(self, text: str) -> tuple[list[int], int, int]:
        """Ids and score of the best path and what the second path loses, as ``nbest`` has them, in one pass forwards."""
        n, tree, unknown = len(text), self.tree, self.unknown
        top, below, came, piece = [LOW] * (n + 1), [LOW] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        top[0] = 0
        for s in range(n):
            a, b = top[s], below[s]
            node, e = tree.get(text[s]), s + 1
            if node is None or node[0] is None:
                w, i, after = unknown, -1, node[2] if node else None
            else:
                w, i, after = node
            while True:
                if w is not None:
                    # of equal paths the first has the longer last piece
                    if (x := a + w) > top[e]:
                        below[e] = max(top[e], b + w)
                        top[e], came[e], piece[e] = x, s, i
                    elif x > below[e]:
                        below[e] = x
                if not after or e == n:
                    break
                node = after.get(text[e])
                if node is None:
                    break
                w, i, after = node
                e += 1
        path, e = [], n
        while e:
            path.append((came[e], e, piece[e]))
            e = came[e]
        return self.spell(text, path[::-1]), top[n], top[n] - below[n] if below[n] > LOW else NO_LOSS

    def parts(self, text: str) -> list[str]:
        """``text``, cut where no piece holds both neighbours."""
        joined = self.joined
        cuts = [k for k, pair in enumerate(zip(text, text[1:]), 1) if pair not in joined]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])] if cuts else [text]

    def spell(self, text: str, path: list[tuple[int, int, int]]) -> list[int]:
        ids: list[int] = []
        for s, e, i in path:
            ids += [i] if i >= 0 else [self.bytes[b] for b in text[s:e].encode()]
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; the blank in front is taken away."""
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode(errors="replace").removeprefix(" ")

    def encode(self, text: str, n: int = 1) -> list[tuple[int, list[int]]]:
        """The ``n`` best (score, ids) of a whole text, without units."""
        if not text:
            return [(0, [])]
        text = BLANK + text.replace(" ", BLANK)
        return [(w, self.spell(text, path)) for w, path in self.nbest(text, n)]

    def _remember(self, ids, best: int, loss: int) -> int:
        self.ids.extend(ids)
        self.starts.append(len(self.ids))
        self.best.append(best)
        self.loss.append(loss)
        return len(self.best) - 1

    def part(self, text: str) -> int:
        """Number of the remembered part."""
        got = self.known_parts.get(text)
        if got is None:
            if len(text) <= SHORT:
                ids, best, loss = self.best_two(text)
            else:
                paths = self.nbest(text, 2)
                ids, best = self.spell(text, paths[0][1]), paths[0][0]
                loss = best - paths[1][0] if len(paths) > 1 else NO_LOSS
            got = self.known_parts[text] = self._remember(ids, best, loss)
        return got

    def unit(self, word: str) -> int:
        """Number of the remembered unit ▁ + ``word``."""
        got = self.units.get(word)
        if got is None:
            of = [self.part(p) for p in self.parts(BLANK + word)]
            if len(of) == 1:
                got = of[0]
            else:
                starts, ids = self.starts, self.ids
                got = self._remember([i for k in of for i in ids[starts[k] : starts[k + 1]]], sum(self.best[k] for k in of), min(self.loss[k] for k in of))
            self.units[word] = got
        return got

    def deep(self, word: str) -> list[tuple[int, np.ndarray]]:
        """(loss, ids) of all N paths of a unit."""
        got = self.more.get(word)
        if got is None:
            if self.held >= CACHED_DEEP:
                self.more.clear()
                self.held = 0
            parts = self.parts(BLANK + word)
            # of equal losses the earlier parts
            open_ = sorted((self.loss[k], at) for at, p in enumerate(parts) if self.loss[k := self.part(p)] < NO_LOSS)[: self.n - 1]
            paths = [[(w, self.spell(parts[at], path)) for w, path in self.nbest(parts[at], self.n)] for _, at in open_]
            got = []
            for loss, moves in least_sums([[x[0][0] - w for w, _ in x] for x in paths], self.n):
                change = {open_[j][1]: paths[j][k][1] for j, k in moves}
                ids = [self.ids[self.starts[k] : self.starts[k + 1]] for k in map(self.part, parts)]
                got.append((loss, np.array([i for at, x in enumerate(ids) for i in change.get(at, x)], np.int32)))
            self.more[word] = got
            self.held += 8 + sum(len(ids) for _, ids in got)
        return got


_pieces: dict[tuple[str, int], Pieces] = {}


def pieces_of(path: str, n: int = N_BEST) -> Pieces:
    if (path, n) not in _pieces:
        _pieces[path, n] = Pieces(path, n)
    return _pieces[path, n]


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = True, n: int = N_BEST) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian 32-bit ids), best_score, second_score (null if there is no second path), round_trip; with ``with_ids`` the ids.

    ``nbest`` has the ``n`` best paths, fewer if there are no more, as structs (score, n_pieces, ids_crc32, round_trip, with ``with_ids`` ids).
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    names_of = ["score", "n_pieces", "ids_crc32", "round_trip"] + ["ids"] * with_ids
    depth = max(n, 2)

    def some(pieces: Pieces, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        texts = texts.fill_null("").cast(pa.large_string())
        # in the lattice a literal blank mark is a blank
        words = pc.split_pattern(pc.replace_substring(texts, BLANK, " "), " ")
        coded = words.flatten().dictionary_encode()
        if len(pieces.units) > CACHED_UNITS or len(pieces.ids) > CACHED_IDS:
            pieces.forget()
        known, which = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        at = words.offsets.to_numpy()
        at = at - at[0]
        # an empty word is one more blank in front of the next one; only at a text's end it stands alone
        ends_unit = np.ones(len(which), bool)
        if "" in known:
            ends_unit = which != known.index("")
            ends_unit[at[1:] - 1] = True
        place = np.flatnonzero(ends_unit)
        blanks = np.diff(place, prepend=-1)
        at = np.searchsorted(place, at)
        word, single, unit = which[place], blanks == 1, pieces.unit
        # each distinct word is looked up once
        slots, met = np.zeros(len(known), np.int64), np.flatnonzero(np.bincount(word[single], minlength=len(known)))
        slots[met] = [unit(known[c]) for c in met.tolist()]
        name = lambda k: BLANK * (int(blanks[k]) - 1) + known[word[k]]
        u = slots[word]
        for k in np.flatnonzero(~single).tolist():
            u[k] = unit(name(k))
        starts, ids = np.frombuffer(pieces.starts, np.int64), np.frombuffer(pieces.ids, np.int32) if pieces.ids else np.zeros(0, np.int32)
        best, loss = (np.frombuffer(x, np.int64) if x else np.zeros(0, np.int64) for x in (pieces.best, pieces.loss))
        size = starts[u + 1] - starts[u]
        ends = np.cumsum(size)
        every = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[u] - ends + size, size)]
        total, gaps = np.concatenate([[0], np.cumsum(best[u])]), loss[u]
        paths, score, second, ends_at = [], [], [], [0]
        _, bounds = bw.column(texts)
        for i in range(len(texts)):
            if bounds[i] == bounds[i + 1]:  # empty: one path without pieces
                paths.append(every[:0])
                score.append(0)
                second.append(None)
                ends_at.append(len(paths))
                continue
            a, b = int(at[i]), int(at[i + 1])
            first = int(ends[a] - size[a])
            top, whole, mine = every[first : ends[b - 1]], int(total[b] - total[a]), gaps[a:b]
            where = np.flatnonzero(mine < NO_LOSS)
            if len(where) > depth - 1:
                cut = np.partition(mine[where], depth - 2)[depth - 2]
                below = where[mine[where] < cut]
                where = np.concatenate([below, where[mine[where] == cut][: depth - 1 - len(below)]])
            where = sorted(where.tolist(), key=lambda k: (mine[k], k))
            deep = [pieces.deep(name(a + k)) for k in where]
            sums = least_sums([[lost for lost, _ in x] for x in deep], depth)
            second.append(whole - sums[1][0] if len(sums) > 1 else None)
            for lost, moves in sums[:n]:
                parts, done = [], 0
                for k, j, rank in sorted((where[j], j, rank) for j, rank in moves):
                    parts += [top[done : ends[a + k] - size[a + k] - first], deep[j][rank][1]]
                    done = ends[a + k] - first
                paths.append(np.concatenate([*parts, top[done:]]) if parts else top)
                score.append(whole - lost)
            ends_at.append(len(paths))
        # every path is decoded as a whole and compared with its text
        flat = np.concatenate([np.zeros(0, np.int32), *paths])
        stops = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int64)
        _, spelled, raw = pieces.spelled.take(pa.array(flat)).buffers()
        raw, cuts = memoryview(raw) if raw else b"", np.frombuffer(spelled, np.int64)[stops]
        data, of = memoryview(bw.column(texts)[0]), np.repeat(np.arange(len(texts)), np.diff(ends_at))
        again = [bytes(raw[x : y]).removeprefix(b" ") == bytes(data[bounds[t] : bounds[t + 1]]) for x, y, t in zip(cuts[:-1].tolist(), cuts[1:].tolist(), of.tolist())]
        crcs = [zlib.crc32(p.astype("<i4", copy=False).tobytes()) for p in paths]
        cols = [pa.array(np.array(score, np.int64) / SCALE), pa.array(np.diff(stops)), pa.array(crcs, pa.int64()), pa.array(again, pa.bool_())]
        cols += [pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(flat))] * with_ids
        heads = pa.array(ends_at[:-1], pa.int64())
        top_score, count, crc, whole_again, *top_ids = (c.take(heads) for c in cols)
        nbest = pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.StructArray.from_arrays(cols, names=names_of))
        seconds = pa.array([None if x is None else x / SCALE for x in second], pa.float64())
        return pa.RecordBatch.from_arrays([keys, count, crc, top_score, seconds, whole_again, *top_ids, nbest], names=["doc_id", "n_pieces", "ids_crc32", "best_score", "second_score", "round_trip"] + ["ids"] * with_ids + ["nbest"])

    def apply(batches):
        pieces = pieces_of(model_path, depth)
        for batch in batches:
            for a, b in bw.slices(batch.column(1), BATCH_BYTES):
                yield some(pieces, batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))

    path = "struct<score: double, n_pieces: long, ids_crc32: long, round_trip: boolean" + ", ids: array<int>" * with_ids + ">"
    schema = "doc_id long, n_pieces long, ids_crc32 long, best_score double, second_score double, round_trip boolean" + ", ids array<int>" * with_ids + f", nbest array<{path}>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(apply, schema)


def decode_documents(coded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """doc_id and the text of each row's ``ids``; null ids give a null text, a number outside the vocabulary raises."""

    def apply(batches):
        pieces = pieces_of(model_path)
        for batch in batches:
            if pc.any(pc.or_(pc.less(flat := batch.column(1).flatten(), 0), pc.greater_equal(flat, len(pieces.raw)))).as_py():
                raise ValueError("an id is outside the vocabulary")
            texts = [None if x is None else pieces.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(apply, "doc_id long, text string")
