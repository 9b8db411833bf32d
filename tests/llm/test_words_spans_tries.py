"""Spelling variants, repeated spans and prefix tries against brute force and DuckDB."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from svloom.llm import prefix_trie as pt, queries, spelling as sp, suffix_dedup as sd
from svloom.llm.shared import Workspace

TYPES = {"bigint": "BIGINT", "string": "VARCHAR"}


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_suffix_array_dedup", "op13_prefix_trie"])
def test_queries_equal_their_sql(spark, duck, sf, name):
    got = queries.queries()[name](spark, sf)
    relation = duck.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(relation.columns)
    assert {c: TYPES[t] for c, t in got.dtypes} == {c: str(t) for c, t in zip(relation.columns, relation.types)}
    expected = relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert len(expected) > 40 and sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, expected))


# --- spelling ---


def edits(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    counts = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % sp.DAMAGE == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if n >= 3}
    out = {}
    for w, n in words.items():
        near = [x for x in words if edits(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 2 * n else None
        out[w] = [n, len(near), form, words.get(form), w]
    for w in out:
        while out[out[w][4]][2]:
            out[w][4] = out[out[w][4]][2]
    return {w: tuple(x) for w, x in out.items()}


def variants(docs, spark, kind="doc_id long, text string"):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in sp.variant_groups(spark.createDataFrame(docs, kind).repartition(4)).collect()}


def word_documents():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abÉéÿ") for _ in range(rnd.randrange(4, 8))) for _ in range(250)]
    docs = [(i if i % 9 else None, ", ".join(w.upper() if rnd.random() < 0.1 else w for w in rnd.choices(words, [1 / (k + 1) for k in range(250)], k=200))) for i in range(60)]
    long = "x" * 700 + "".join(rnd.choice("pq") for _ in range(500))
    docs += [(100, " ".join([long] * 3 + [long[:600] + long[601:]] * 7 + [long + "q"] * 3 + [long[:-3] + "ppp"] * 3)), (101, None), (102, ""), (103, "1 2 3 ×÷ª")]
    return docs + docs[:3]


@pytest.mark.parametrize("size", [sp.SHARD_CHARS, 300])
def test_variants_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(sp, "SHARD_CHARS", size)
    docs = word_documents()
    expected = plain_variants(docs)
    assert variants(docs, spark) == expected
    assert sum(x[2] is not None for x in expected.values()) > 20 and max(x[1] for x in expected.values()) > 3
    assert any(x[4] != w and x[4] != x[2] for w, x in expected.items())


def test_damage_and_ties(spark):
    damaged = next(w for w in (f"word{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(26) for b in range(26) for c in range(26)) if zlib.crc32(f"1:{w}".encode()) % 97 == 0)
    docs = [(1, " ".join([damaged] * 4)), (2, "abcde " * 3 + "abcdf " * 6 + "abcdg " * 6)]
    got = variants(docs, spark)
    assert damaged not in got and got == plain_variants(docs)
    assert got["abcde"][2:] == ("abcdf", 6, "abcdf")  # a tie goes to the smaller word; twice as many are enough


def test_words_of_odd_tables(spark):
    assert variants([], spark) == {}
    extra = spark.createDataFrame([("x", 1, "gamma gamma gamma gammas gammas gammas", 7)], "word string, doc_id int, text string, n int")
    assert sorted((r.word, r.n_near, r.form) for r in sp.variant_groups(extra).collect()) == [("gamma", 1, None), ("gammas", 1, None)]


# --- repeated spans ---


def plain_spans(docs):
    first = {}
    for doc_id, text in docs:
        data = (text or "").encode()
        if doc_id is not None:
            for i in range(len(data) - 49):
                s = data[i : i + 50]
                first[s] = min(first.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if doc_id is not None and first[data[i : i + 50]] < doc_id:
                gone[i : i + 50] = b"\1" * 50
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def span_documents():
    rnd = random.Random(7)
    some = lambda n: "".join(rnd.choice("abcd éß\x00") for _ in range(n))
    passages = [some(n) for n in (49, 50, 51, 90, 300, 2000)]
    docs = [(i * 3 % 101, some(rnd.randrange(400)) + rnd.choice(passages) + some(rnd.randrange(60)) + rnd.choice(passages)) for i in range(70)]
    base = some(1500)
    docs += [(200 + i, base[: 70 * i] + some(1) + base[70 * i :]) for i in range(20)]  # near copies
    docs += [(300 + i, "ab" * 400 + some(5)) for i in range(5)] + [(400, "a" * 3000), (401, "a" * 120), (402, base), (403, base), (403, base + "x"), (None, base), (None, base), (404, None), (405, ""), (406, "short")]
    return docs + docs[:4]


def spans(docs, spark, with_text=False):
    rows = sd.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), with_text=with_text).collect()
    return sorted([tuple(r) for r in rows], key=str)


@pytest.mark.parametrize("bundle,counted,sorted_,hot,slice_", [(1 << 20, 1 << 20, 1 << 20, 1 << 15, 1 << 16), (700, 64, 300, 1 << 15, 100), (5000, 500, 2000, 3, 64)])
def test_spans_equal_brute_force(spark, monkeypatch, bundle, counted, sorted_, hot, slice_):
    """Also with many bundles and shards, and with names so hot that their windows go one by one."""
    for name, value in (("BUNDLE", bundle), ("COUNTED", counted), ("SORTED", sorted_), ("HOT", hot), ("SLICE", slice_)):
        monkeypatch.setattr(sd, name, value)
    docs = span_documents()
    got = spans(docs, spark)
    assert got == plain_spans(docs)
    assert sum(r[2] > 0 for r in got) > 40 and max(r[3] for r in got) >= 2


def test_text_that_is_left(spark):
    passage = "Ein Satz, der sich wörtlich in mehreren Texten findet und lang genug ist."
    docs = [(1, f"eins {passage} zwei"), (2, f"drei {passage} vier"), (3, passage)]
    left = {r[0]: bytes(r[5]).decode() for r in spans(docs, spark, with_text=True)}
    assert left == {1: docs[0][1], 2: "dreivier", 3: ""}


def test_spans_of_odd_tables(spark):
    assert spans([], spark) == []
    extra = spark.createDataFrame([("x", 1, "z" * 60, 7), ("y", 2, "z" * 60, 8)], "bundle string, doc_id int, text string, ids int")
    assert sorted((r.doc_id, r.n_removed) for r in sd.repeated_spans(extra).collect()) == [(1, 0), (2, 60)]


def test_suffix_array_and_prefixes():
    rnd = random.Random(1)
    for _ in range(400):
        letters = rnd.choice([b"a", b"ab", b"\0a", b"abc\xff", bytes(range(256))])
        text = bytes(rnd.choice(letters) for _ in range(rnd.randrange(60)))
        data = np.frombuffer(text, np.uint8)
        suffixes = sd.suffix_array(data)
        expected = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffixes.tolist() == expected
        common = [next((k for k in range(17) if a + k >= len(text) or b + k >= len(text) or text[a + k] != text[b + k]), 17) for a, b in zip(expected, expected[1:])]
        assert sd.common_prefixes(data, suffixes, 17).tolist() == [0] * bool(text) + common


# --- tries ---


def plain_trie(paths):
    """Nodes of {conv_id: [(role, text), ...]} by loops."""
    members = {}
    for conv, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    rows = []
    for node, convs in members.items():
        kids = [n for n in members if len(n) == len(node) + 1 and n[: len(node)] == node]
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in convs if len(paths[c]) == len(node))
        rows.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members) for n in below), sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversation_rows():
    rnd = random.Random(3)
    rows = []
    for conv in [*range(-5, 60), 1000, 1001]:
        turns = [rnd.choice("xy") for _ in range(rnd.randrange(4))] + ["same"] * (12 if conv % 7 == 0 else 0) + [str(conv)] * (conv % 3)
        rows += [(conv, None if d == 0 else d * 2, rnd.choice(["u", None]) if t == "x" else "u", None if t == "y" and d == 1 else t * (1 + d)) for d, t in enumerate(turns)]
    return rows + [(None, 1, "u", "nobody's"), (7, 5, "u", "twice"), (7, 5, "u", "twice"), (7, 5, "a", "first of equals")]


def ordered(rows):
    paths = {}
    for conv, turn, role, text in sorted([r for r in rows if r[0] is not None], key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        paths.setdefault(conv, []).append((role or "", text or ""))
    return paths


KIND = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("steps,chunk", [(8, 4096), (1, 3)])
def test_tries_equal_brute_force(spark, monkeypatch, steps, chunk):
    monkeypatch.setattr(pt, "STEPS", steps)
    monkeypatch.setattr(pt, "CHUNK", chunk)
    rows = conversation_rows()
    got = pt.prefix_trie(spark.createDataFrame(rows, KIND).repartition(3))
    assert sorted(tuple(r) for r in got.select(COLUMNS).collect()) == plain_trie(ordered(rows))


def test_rebuilt_conversations(spark):
    rows = conversation_rows() + [(200, 1, "u", "head"), (200, 2, "a", "reply"), (200, 3, "u", "more")] + [(c, k, "u", f"{c} {k}") for c in [*range(201, 230), *range(301, 330)] for k in range(c % 5 + 1)]
    plain = ordered(rows)
    paths = {}
    for c in plain:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        paths[c] = plain.get(base, [])[:h] + plain[c][h:]
    assert any(not p for p in paths.values())
    df = spark.createDataFrame(rows, KIND)
    ws = Workspace(spark, "test")
    got = pt.trie(*pt.rebuilt(df, pt.numbered_turns(ws, df)), ws)
    assert sorted(tuple(r) for r in got.select(COLUMNS).collect()) == plain_trie(paths)


def test_tries_of_odd_tables(spark):
    assert pt.prefix_trie(spark.createDataFrame([], KIND)).count() == 0
    one = pt.prefix_trie(spark.createDataFrame([(5, 1, None, None, "x", 3)], KIND + ", node string, depth int"))
    assert sorted(tuple(r) for r in one.select(COLUMNS).collect()) == plain_trie({5: [("", "")]})


def test_turns_are_numbered_across_ranges(spark):
    rows = spark.range(5000).select(F.lit(1).alias("conv_id"), (F.col("id") * 7919 % 5000).alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    got = pt.numbered_turns(Workspace(spark, "test"), rows.unionByName(rows.withColumn("conv_id", F.lit(2))))
    assert [r.d for r in got.where("conv_id = 1").orderBy("d").collect()] == list(range(1, 5001))
