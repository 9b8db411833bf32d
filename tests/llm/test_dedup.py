"""Near-duplicates of documents and embeddings against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from svloom.llm import embedding_dedup as ed, minhash as mh
from svloom.llm.shared import Workspace, connected_components


def components(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def shingles(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def texts():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    out = ["", None, "one", "ONE", "one two", "a b\x0bc d e", "A B C D E"]
    base = [word() for _ in range(120)]
    for i in range(40):  # near copies of one another, at all distances around the limit
        copy = list(base)
        for _ in range(i % 9):
            copy[rnd.randrange(120)] = word()
        out.append(" ".join(copy))
    out += [" ".join(passage + [word() for _ in range(n)]) for n in (5, 8, 30, 60, 90) for _ in range(6)]
    out += [" ".join(word() for _ in range(900))] * 3 + [" ".join(word() for _ in range(20)) for _ in range(10)]
    return out


def test_documents_against_brute_force(spark):
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, value string, n int").repartition(5)
    got = {r.doc_id: r for r in mh.near_duplicates(docs).collect()}
    sets = [shingles(t) for t in texts()]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[b]]
    expected = components(len(sets), links)
    assert len(links) > 100
    assert [got[i].component_id for i in range(len(sets))] == expected
    assert [got[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]
    assert all(got[i].kept == (expected[i] == i) for i in range(len(sets)))


def test_documents_without_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "z z z"), (3, None)], "doc_id long, text string")
    got = sorted(map(str, (tuple(r)[:4] for r in mh.near_duplicates(docs).collect())))
    assert got == sorted(map(str, [(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (None, 1, None, True), (3, 0, 3, True)]))
    assert mh.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_without_ids_or_under_one_id(spark):
    """Null and repeated doc_ids link with near copies by their own texts, checked by brute force over rows."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    bases = [[word() for _ in range(150)] for _ in range(4)]

    def edited(base, edits):
        copy = list(base)
        for k in rnd.sample(range(len(copy)), edits):
            copy[k] = word()
        return " ".join(copy)

    rows = [(10, edited(bases[0], 0)), (None, edited(bases[0], 1)), (20, edited(bases[0], 1)), (20, edited(bases[1], 0)), (30, edited(bases[1], 1)), (30, edited(bases[2], 0))]
    rows += [(None, edited(bases[3], 0)), (None, edited(bases[3], 1)), (None, edited(bases[3], 1)), (30, edited(bases[0], 1)), (5, edited(bases[2], 1)), (30, edited(bases[2], 0)), (None, " ".join(bases[0]))]
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    group = components(len(rows), links)
    smallest = {g: min((d for (d, _), h in zip(rows, group) if h == g and d is not None), default=None) for g in group}
    expected = [(d, len(s), smallest[g], d == smallest[g] or smallest[g] is None) for (d, _), s, g in zip(rows, sets, group)]
    assert len(set(group)) == 4 and list(smallest.values()).count(None) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = mh.near_duplicates(docs).collect()
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, expected))
    assert len({r.group for r in got}) == 4


def test_a_template_with_edits_stays_linear(spark):
    """Texts with most of their shingles in common but no links: candidates don't grow with the square of their number."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    core = [word() for _ in range(160)]
    made = {}
    for n in (150, 600):
        rows = [(i, i, [f"c{k}" for k in range(80)] + [f"{i}-{k}" for k in range(20)]) for i in range(n)]
        rows += [(n + 1, n + 1, [f"c{k}" for k in range(80)] + [f"0-{k}" for k in range(18)]), (n + 2, n + 2, [f"c{k}" for k in range(78)])]
        sets = spark.createDataFrame(rows, "cid long, component long, names array<string>").selectExpr("cid", "component", "transform(names, x -> xxhash64(x)) as values")
        pairs = {(min(r), max(r)) for r in map(tuple, mh.prefix_pairs(Workspace(spark, "t"), sets).collect())}
        plain = {i: set(names) for i, _, names in rows}
        linked = {(a, b) for b in (n + 1, n + 2) for a in plain if a != b and 100 * len(plain[a] & plain[b]) >= 75 * len(plain[a] | plain[b])}
        linked = {(min(x), max(x)) for x in linked}
        assert len(linked) > n and linked <= pairs
        made[n] = len(pairs)
    assert made[600] < 5 * made[150]
    texts = [" ".join(core[:20] + [w if rnd.random() > 0.012 else word() for w in core[20:]]) for _ in range(300)]
    got = {r.doc_id: r for r in mh.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(300), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert [got[i].component_id for i in range(300)] == components(300, links)


def test_prefixes_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK", 3)
    rnd = random.Random(11)
    rows = []
    for i in range(120):
        base = [f"b{i % 5}-{k}" for k in range(rnd.randrange(30, 60))]
        rows.append((i, rnd.randrange(40), rnd.sample(base, int(len(base) * rnd.uniform(0.8, 1))) + [f"{i}-{k}" for k in range(rnd.randrange(6))]))
    sets = spark.createDataFrame(rows, "cid long, component long, names array<string>").selectExpr("cid", "component", "transform(names, x -> xxhash64(x)) as values")
    got = {(min(r), max(r)) for r in map(tuple, mh.prefix_pairs(Workspace(spark, "t"), sets).collect())}
    plain = [(i, c, set(names)) for i, c, names in rows]
    linked = {(a[0], b[0]) for a, b in itertools.combinations(plain, 2) if a[1] != b[1] and 100 * len(a[2] & b[2]) >= 75 * len(a[2] | b[2])}
    assert len(linked) > 50 and linked <= got


def test_needed_overlap_covers_all_linked_pairs():
    for n in (1, 5, 40, 72, 96, 97, 128):
        for other in range(n, int(n / 0.75) + 1):
            need = -(-3 * (n + other) // 7)  # least intersection of linked sets
            if need > n:
                continue
            if other <= mh.K:
                assert mh.need(n) <= need and mh.need(other) <= need
            assert mh.need(n) >= 1


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(200)]
    edges = spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(Workspace(spark, "t"), edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(201))


@pytest.mark.parametrize("how", [p[1:] for p in ed.PLANS])
def test_recall_at_the_threshold(how):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1)[:, None]
    p, q = ed.probes(x, *how), ed.probes(y, *how)
    met = np.stack([ed.meet(p[:, t], q[:, t]) for t in range(how[2])], 1)
    assert met.any(1).all() and np.prod(1 - met.mean(0)) < 2e-5


@pytest.mark.parametrize("how", [None] + [p[1:] for p in ed.PLANS[1:]])
def test_embeddings_against_brute_force(spark, how):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = [b + rng.normal(size=16) * s for b in base for s in (0, 0.1, 0.15, 0.2)] + [base[0] + rng.normal(size=16) * 0.02 for _ in range(700)]
    x = np.array(rows, np.float32)
    vectors = [(i, v.tolist(), "l") for i, v in enumerate(x)] + [(9001, [0.0] * 16, "l"), (9002, None, None), (9003, [float("nan")] * 16, "l"), (9004, [None] * 16, "l"), (9005, [], "l"), (9006, x[3].tolist(), "l"), (9006, x[3].tolist(), "l"), (9007, (x[5] * 4).tolist(), "m"), (9008, [1.0, 2.0], "l")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, n_links string").repartition(4)
    got = ed.near_duplicates(df, how=how).collect()
    assert len(got) == len(vectors)
    ids = list(range(len(x))) + [9006, 9007]
    unit = np.concatenate([x, x[3:4], x[5:6] * 4]).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    expected = components(len(ids), [(a, b) for a, b in zip(*np.nonzero(np.triu(close, 1)))])
    by = {r.vec_id: r for r in got}
    assert [by[i].n_links for i in ids] == (close.sum(1) - 1).tolist()
    assert [by[i].component_id for i in ids] == [ids[c] for c in expected]
    for i in (9001, 9002, 9003, 9004, 9005, 9008):
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
    assert ed.near_duplicates(df.limit(0), how=how).count() == 0


@pytest.mark.parametrize("vectors", [10**5, 615_384, 10**6])
def test_few_copies_of_a_vector_are_shuffled(spark, vectors):
    how = ed.plan(vectors)
    rng = np.random.default_rng(5)
    rows = [(i, 1, v) for i, v in enumerate(rng.normal(size=(20, 64)).tolist())]
    copies = ed._spread(spark.createDataFrame(rows, "key long, weight long, v array<float>"), how, True).collect()
    sent = sum(len(value) if isinstance(value, (bytes, bytearray)) else 8 * len(value) if isinstance(value, list) else 8 for r in copies for value in r)
    assert sent <= 20 * 64 * 4 * 6  # before: 36 copies up to 131,072 vectors, 128 beyond, of whole vectors


def test_blocks_of_large_buckets_and_pairs_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 40 * 16)
    monkeypatch.setattr(ed, "CELL", 30)
    rng = np.random.default_rng(7)
    rows = [rng.normal(size=16) for _ in range(10)]
    rows += [rows[0] + rng.normal(size=16) * 0.25 for _ in range(300)]
    for k in range(40):  # cosines nearer to 0.9 than 16-bit components can tell
        x, z = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
        rows += [x, (0.9 + (k - 19.5) * 1e-7) * x + np.sqrt(1 - (0.9 + (k - 19.5) * 1e-7) ** 2) * z]
    x = np.array(rows)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(3)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    assert close[310::2, 311::2].diagonal().sum() == 20
    expected = components(len(x), [(a, b) for a, b in zip(*np.nonzero(np.triu(close, 1)))])
    by = {r.vec_id: r for r in ed.near_duplicates(df, how=(1, 8, 1)).collect()}
    assert [by[i].n_links for i in range(len(x))] == (close.sum(1) - 1).tolist()
    assert [by[i].component_id for i in range(len(x))] == list(expected)
