"""Packing, quality rules, classifiers, SentencePiece and language ID on small fixtures."""

import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from svloom.llm import language_id as li, packing as pk, quality_classifier as qc, quality_rules as qr, queries, sentencepiece_nbest as sn, toxicity as tx

ODD = [None, "", "   ", "a", "word " * 3000, "Ünïcode ﬁ ß ẞ İstanbul ΣΑΣ", "I'LL don't 1234 ab12 <|endoftext|> x<|endoftext|>y", "a\x1cb\x85c\u2003d e", "日本語 テスト 👍🏽", "x\n\ny\n# $ %\n", "\n".join(["same line"] * 40), "the cat. " * 500]


@pytest.fixture()
def docs(spark):
    rows = [(i, t, "en", i) for i, t in enumerate(ODD)] + [(3, "a", "de", 9), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def check_pieces(pieces, lengths):
    sequences, documents = defaultdict(list), defaultdict(list)
    for d, start, n, s, at in pieces:
        assert n > 0
        sequences[s].append((at, n))
        documents[d].append((start, n))
    for parts in sequences.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end == 2048 or end & (end - 1) == 0 and end < 2048
    for d, parts in documents.items():
        end = 0
        for start, n in sorted(parts):
            assert start == end
            end += n
        assert end == lengths[d]


def test_packing_is_gapless_and_balanced():
    rng = np.random.default_rng(1)
    for lengths in ([1], [2048], [5000], [3] * 700, rng.integers(1, 4000, 900).tolist()):
        check_pieces(pk.pack(lengths), dict(enumerate(lengths)))
    cost = defaultdict(float)
    for _, _, n, s, _ in pk.pack(rng.integers(50, 900, 4000).tolist()):
        cost[s] += n + pk.QUADRATIC * n * n
    values = np.array(list(cost.values()))
    assert np.quantile(values, 0.9) < 1.25 * np.quantile(values, 0.1)


def test_packing_ids_are_the_tokenizers(spark, docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole = Tokenizer.from_file(path)
    rows = pk.pack_documents(docs, path).collect()
    for i, text in enumerate(ODD):
        mine = sorted([r for r in rows if r.doc_id == i], key=lambda r: r.start)
        expected = whole.encode(text or "", add_special_tokens=False).ids + [1]
        if i != 3:
            assert [t for r in mine for t in r.ids] == expected
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) and r.doc_tokens == len(expected) for r in mine)
    check_pieces([(j, 0, r.length, r.sequence_id, r.offset) for j, r in enumerate(rows)], {j: r.length for j, r in enumerate(rows)})
    assert pk.pack_documents(docs.limit(0), path).count() == 0


def test_frequent_words_stay_remembered(monkeypatch):
    """Rare words never drive out those that come again; spellings of the same letters are one."""
    from types import SimpleNamespace

    tokenizer = pk.WordTokenizer(queries.tokenizer_path())
    whole, asked = tokenizer.tokenizer, defaultdict(int)

    def tokenize(part):
        asked[part] += 1
        return whole.model.tokenize(part)

    tokenizer.tokenizer = SimpleNamespace(model=SimpleNamespace(tokenize=tokenize), encode=whole.encode, normalizer=whole.normalizer, pre_tokenizer=whole.pre_tokenizer)
    monkeypatch.setattr(pk, "CACHED_WORDS", 300)
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(6))
    letters = [chr(c) for c in range(0xC0, 0x250) if chr(c).isalpha()]
    for batch in range(12):
        common = " ".join(f"{name(i)} {name(i).title()}, {name(i).upper()}!?" for i in range(40))
        texts = [common, None, " ".join(name(10**6 + 1000 * batch + i) + ("7" if i % 9 == 0 else "") for i in range(250)), ""] + [" ".join(f"a{c}b." for c in letters)] * (batch == 11)
        ids, at = tokenizer.encode(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids
    assert max(asked[name(i)] for i in range(40)) == 1


def brute_rules(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    again = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_quality_rules_statistics_and_score(spark, sf):
    real = queries.table(spark, sf, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)] + [(0, "twice the id"), (None, None)], "doc_id long, text string")
    docs = real.unionAll(extra)
    target = queries.trusted(spark, sf)
    rows = qr.quality_rules(docs.withColumn("kept", docs["doc_id"]), target).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= qr.THRESHOLD)
    # the score, from bucket numbers that Spark's hash gives to words and pairs
    import pyspark.sql.functions as F

    trusted = {r.doc_id for r in target.collect()}
    words = {i: re.findall("[^\x20\x09-\x0D]+", r.text or "") for i, r in enumerate(rows)}
    grams = sorted({w for ws in words.values() for w in ws})
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for w in grams], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = sorted({(hashed[a], hashed[b]) for ws in words.values() for a, b in zip(ws, ws[1:])})
    both = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    buckets = {i: [hashed[w] % qr.BUCKETS for w in ws] + [both[hashed[a], hashed[b]] % qr.BUCKETS for a, b in zip(ws, ws[1:])] for i, ws in words.items()}
    raw, good = np.ones(qr.BUCKETS), np.ones(qr.BUCKETS)
    for i, r in enumerate(rows):
        np.add.at(raw, buckets[i], 1)
        if r.doc_id in trusted:
            np.add.at(good, buckets[i], 1)
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    assert all(abs(r.score - (ratio[buckets[i]].mean() if buckets[i] else 0)) < 1e-4 for i, r in enumerate(rows))


def test_quality_rules_without_target_and_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long")
    assert {r.score for r in qr.quality_rules(docs.drop("score"), none).collect()} == {0.0}
    assert qr.quality_rules(docs.drop("score").limit(0), none).count() == 0


def test_quality_rules_with_clashing_columns(spark, docs):
    ratios = qr.log_ratios(qr.counts(docs, spark.createDataFrame([(3,), (11,)], "doc_id long")))
    plain = {(r.doc_id, r.text): r for r in qr.judge(docs, ratios).collect()}
    clash = docs
    for c in ("__w", "__lines", "__h", "__s", "__p", "kept", "___w"):
        clash = clash.withColumn(c, F.lit("x"))
    for r in qr.judge(clash, ratios).collect():
        same = plain[r.doc_id, r.text]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.score, r.kept) == (same.n_words, same.n_repeat_words, same.n_dup_lines, same.score, same.kept) and r["__w"] == r["___w"] == "x"


def test_quality_rules_plan_has_no_python(spark, sf):
    plan = queries.op4_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def held_out(spark, name, label, threshold):
    rows = queries.queries()[name](spark, "/root/testdata/sf0.1").alias("q").join(queries.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").collect()
    y = np.array([r[label] for r in rows])
    p = np.array([r.score for r in rows])
    assert ((p >= 0) & (p <= 1)).all() and all(r.predicted == int(r.score >= threshold) for r in rows)
    return p[y == 1], p[y == 0]


def test_toxicity_held_out(spark):
    # 2,600 labelled documents to learn from; the README has the figures of larger tables
    toxic, clean = held_out(spark, "op9_toxicity", "toxic", tx.THRESHOLD)
    assert (toxic[:, None] > clean[None, :]).mean() > 0.97
    assert (toxic >= tx.THRESHOLD).mean() > 0.7 and (clean >= tx.THRESHOLD).mean() < 0.01


def test_quality_classifier_held_out(spark):
    good, bad = held_out(spark, "op6_quality_classifier", "quality", qc.THRESHOLD)
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and (good >= qc.THRESHOLD).mean() > 0.95


def test_scores_pass_other_columns_and_odd_texts(spark, docs):
    model = (np.array([5], np.int32), np.array([1.0], np.float32), -1.0)
    rows = tx.scores(docs, model).collect()
    assert len(rows) == len(ODD) + 2 and rows[0].asDict().keys() == {"doc_id", "text", "lang", "score"} and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in qc.scores(docs, None).collect()} == {0.5}
    net = qc.Net()
    assert all(0 <= r.score <= 1 for r in qc.scores(docs, net.p).collect()) and qc.scores(docs.limit(0), net.p).count() == 0


def test_convolution_covers_the_whole_text():
    net = qc.Net()
    net.p["out"] += 1
    from svloom.llm import bytewords as bw

    plain = "a" * 5000
    score = lambda t: net.scores(*bw.column(pa.array([t])))[0]
    assert all(abs(score(plain[:k] + "ZQXW!!#" + plain[k:]) - score(plain)) > 0 for k in (0, 505, 512, 2500, 4990))


def test_gradient_of_the_network():
    from svloom.llm import bytewords as bw

    data, offsets = bw.column(pa.array(["hello world " * 60, "spam!!! " * 20]))
    y = np.array([1.0, 0.0], np.float32)
    net = qc.Net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["out"] += np.linspace(-0.5, 0.5, len(net.p["out"]))
    loss = lambda: -np.log(np.where(y == 1, (p := net.scores(data, offsets)), 1 - p)).mean()
    before = {k: v.copy() for k, v in net.p.items()}
    net.step(data, offsets, y, 0.0)
    for k in ("out", "bias", "filters", "embed"):
        g = net.m[k] / 0.1
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.p = {x: v.copy() for x, v in before.items()}
        net.p[k][at] += 1e-5
        up = loss()
        net.p[k][at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-2 * abs(g[at]) + 1e-6


@pytest.fixture(scope="module")
def pieces():
    return sn.Pieces(queries.tokenizer_path("piece_bpe_32k.model"))


def test_nbest_against_all_paths(pieces):
    def every(text):
        out = []

        def walk(s, score):
            if s == len(text):
                out.append(score)
                return
            single = False
            for e in range(s + 1, len(text) + 1):
                if text[s:e] in pieces.score:
                    single |= e == s + 1
                    walk(e, score + pieces.score[text[s:e]][0])
            if not single:
                walk(s + 1, score + pieces.unknown)

        walk(0, 0)
        return sorted(out, reverse=True)

    for text in ("hello", "a  b", "日本𝒳x", "x\ny", "the cat", ".......=", "-----------", "a" + " " * 9 + "b", "   "):
        scores = every(sn.BLANK + text.replace(" ", sn.BLANK))
        found = pieces.encode(text, 6)
        assert [w for w, _ in found] == scores[:6] and len({tuple(ids) for _, ids in found}) == len(found)
        assert all(pieces.decode(ids) == text for _, ids in found)


def test_two_best_paths_of_a_part_need_one_pass(pieces, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for letters in ("abeinrst", "ab-.=", "▁ae", "é日x\n", "lo") for _ in range(300)]
    texts += [".......=", "-" * 300, "the" * 200, sn.BLANK, "𝒳"]
    expected = []
    for text in texts:
        paths = pieces.nbest(text, 2)
        expected.append((pieces.spell(text, paths[0][1]), paths[0][0], paths[0][0] - paths[1][0] if len(paths) > 1 else sn.NO_LOSS))
    monkeypatch.setattr(pieces, "backward", None)
    pieces.forget()
    for text, (ids, best, loss) in zip(texts, expected):
        k = pieces.part(text)
        assert (pieces.ids[pieces.starts[k] : pieces.starts[k + 1]].tolist(), pieces.best[k], pieces.loss[k]) == (ids, best, loss)


def test_ties_and_long_units_take_linear_time(spark, pieces, monkeypatch):
    steps = 0
    real = pieces.backward

    def counted(text, e):
        nonlocal steps
        steps += 1
        return real(text, e)

    monkeypatch.setattr(pieces, "backward", counted)
    texts = ["......." + "=", ("......." + "=") * 1000, "-" * 10_000, "a" + " " * 16 + "b", " " * 5000, "ab" * 20_000, "line\n" * 4000]
    for text in texts:
        steps = 0
        found = pieces.encode(text, 4)
        assert steps <= 4 * (len(text) + 1) and all(pieces.decode(ids) == text for _, ids in found)
    path = queries.tokenizer_path("piece_bpe_32k.model")
    rows = sn.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    for r in rows:
        whole = pieces.encode(texts[r.doc_id], 4)
        assert [x.score for x in r.nbest] == [w / sn.SCALE for w, _ in whole] and r.ids == whole[0][1] and r.round_trip
    assert rows[3].n_pieces == 4  # a run of blanks is one piece, as in the model's own segmentation


def test_documents_equal_the_whole_lattice(spark, docs, pieces):
    rows = sn.encode_documents(docs, queries.tokenizer_path("piece_bpe_32k.model")).collect()
    for text, r in zip(ODD, [next(x for x in rows if x.doc_id == i) for i in range(len(ODD))]):
        two = pieces.encode(text or "", 2)
        assert r.best_score == two[0][0] / sn.SCALE and r.n_pieces == len(r.ids) and r.round_trip
        assert pieces.decode(r.ids) == (text or "") and r.second_score == (two[1][0] / sn.SCALE if len(two) > 1 else None)
    assert sn.encode_documents(docs.limit(0), queries.tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_documents_have_n_best_paths_and_decode(spark, pieces):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    texts = ["hello there world", "the the the cat", "one\ntwo three\n\nfour", "日本語 テスト", "a", " x  y ", "Ünïcode\nß 👍🏽", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n in (1, 3, 12):
        rows = {r.doc_id: r for r in sn.encode_documents(docs, path, n=n).collect()}
        for i, text in enumerate(texts):
            whole, got = pieces.encode(text or "", n), rows[i].nbest
            assert [x.score for x in got] == [w / sn.SCALE for w, _ in whole] and len({tuple(x.ids) for x in got}) == len(got)
            assert got[0].ids == rows[i].ids == whole[0][1] and all(x.round_trip and pieces.decode(x.ids) == (text or "") for x in got)
    coded = sn.encode_documents(docs, path, n=12)
    for k in (0, 1):
        back = sn.decode_documents(coded.selectExpr("doc_id", f"get(nbest, {k}).ids as ids"), path).collect()
        assert {r.doc_id: r.text for r in back} == {i: (t or "") if k < len(rows[i].nbest) else None for i, t in enumerate(texts)}


def test_round_trip_is_decoded(spark):
    docs = spark.createDataFrame([(0, "a▁b"), (1, "x\n▁y"), (2, "x\ny z")], "doc_id long, text string")
    rows = sn.encode_documents(docs, queries.tokenizer_path("piece_bpe_32k.model"), with_ids=False).collect()
    assert {r.doc_id: r.round_trip for r in rows} == {0: False, 1: False, 2: True}
    assert all([x.round_trip for x in r.nbest] == [r.round_trip] * len(r.nbest) for r in rows)


def test_language_id(spark, sf):
    pages = queries.table(spark, sf, "pages").select("page_id", "url", "html")
    odd = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "no scheme", ""), (10**6 + 2, "http://x.de/", "<html lang='en'><script>never closed"), (None, "http://a.fr/", "x")], "page_id long, url string, html string")
    model = li.train(queries.table(spark, sf, "documents"))
    rows = {r.page_id: r for r in li.identify(pages.unionAll(odd), model).collect()}
    assert len(rows) == pages.count() + 4 and all(0 < r.posterior <= 1 and r.lang in model[0] for r in rows.values())
    declared = [r for r in rows.values() if r.page_id is not None and r.page_id < 10**6]
    assert sum(r.lang == r.declared for r in declared) > 0.95 * len(declared)
    assert rows[10**6 + 2].text_lang is None
    assert li.identify(pages.limit(0), model).count() == 0
    assert {r.lang for r in li.identify(odd, li.train(queries.table(spark, sf, "documents").limit(0))).collect()} == {None}


def test_visible_text():
    assert li.visible("a<!-- x --><script>var t='</p>';</script>b<style>p{}</style> &amp; <b>c</b>").replace(" ", "") == "ab&c"
    # characters whose lower case is longer don't shift what is taken out
    assert li.visible("İİİİ<SCRIPT>hidden</SCRIPT>seen").split() == ["İİİİ", "seen"] and li.visible("<scripture>seen").strip() == "seen"
    long = "x < y <b>" * 200_000
    began = time.perf_counter()
    assert li.visible(long + "<style>") and li.declared(long) is None and li.declared("<html" + " a='" * 100_000) is None
    assert time.perf_counter() - began < 10


def test_declared_language():
    cases = {
        "<html lang=en>": "en", "<HTML LANG='de-AT'>": "de", '<html data-lang="fr" lang="es">': "es", '<html data-lang="fr">': None, "<html lang=spa>": "es",
        "<html lang=est>": "est", "<html lang=ger>": "de", "<htmlx lang=en>": None, "<!-- <html lang=en> --><html lang=fr>": "fr", "<html title='a > b' lang=de>": "de",
        "<html " + "x=1 " * 1000 + "lang=fr>": "fr", "<html lang=''>": None, "<html><p lang=en>": None, "": None,
    }
    assert {k: li.declared(k) for k in cases} == cases


def test_language_posterior_by_hand(spark):
    """The fused posterior of each page against plain loops over the same evidence, with repeated rows, ties and clashing columns."""
    docs = spark.createDataFrame([(1, "the cat sat on the mat and the dog", "en"), (2, "der hund und die katze sind da", "de"), (3, None, "fr"), (None, "x", "es")], "doc_id long, text string, lang string")
    langs, table = li.train(docs)
    assert langs == ["de", "en"]
    counts = np.full((2, 1 << li.BITS), 0.5)
    for k, text in enumerate(["der hund und die katze sind da", "the cat sat on the mat and the dog"]):
        for at in li.trigrams(text).tolist():
            counts[k, at] += 1
    assert np.allclose(table, np.log(counts / counts.sum(1, keepdims=True)))
    pages = [(1, "http://a.x.de/", "<html lang=de>der hund"), (2, "http://a.x.de/2", "the dog"), (2, "http://a.x.de/2", "the dog"), (3, "http://b.x.de", ""), (4, None, None), (5, "http://q.uk/", "<html lang=eng>katze"), (6, "http://c.com", "zz")]
    rows = li.identify(spark.createDataFrame([(*p, 0, "own") for p in pages], "page_id long, url string, html string, vote int, host string"), (langs, table)).collect()
    assert len(rows) == len(pages)
    norm = table - table.mean(0)
    facts = []
    for i, url, page in pages:
        host = (url or "").partition("://")[2].split("/")[0]
        at = li.trigrams(li.visible(page or ""))
        text = norm[:, at].sum(1) / np.sqrt(len(at)) if len(at) else np.zeros(2)
        facts.append((i, host, li.declared(page or ""), text, int(np.argmax(text)) if len(at) else -1))
    levels = lambda h: [h, ".".join(h.split(".")[-2:]), h.split(".")[-1]]
    for i, host, declared, text, vote in facts:
        others = [f for f in facts]
        score = []
        for k in range(2):
            own = (vote == k, vote >= 0)
            every = [f for f in others if f[4] >= 0]
            up = (sum(f[4] == k for f in every) - own[0] + 1) / (len(every) - own[1] + 2)
            for level in (2, 1, 0):
                same = [f for f in every if levels(f[1])[level:] == levels(host)[level:]]
                up = (sum(f[4] == k for f in same) - own[0] + li.SMOOTH * up) / (len(same) - own[1] + li.SMOOTH)
            s = float(text[k]) + np.log(up)
            for said, right in ((declared, li.DECLARED), (li.SUFFIXES.get(levels(host)[2]), li.SUFFIX)):
                if said in langs:
                    s += np.log(right if said == langs[k] else 1 - right)
            score.append(s)
        p = np.exp(np.array(score) - max(score))
        for r in [r for r in rows if r.page_id == i]:
            assert r.lang == langs[int(np.argmax(score))] and r.posterior == pytest.approx(max(p / p.sum()), abs=1e-5)


def test_the_sample_of_labelled_documents(spark):
    words = ["good plain words here", "bad!!! $$$ buy", "fine calm prose again", "spam spam &&& ###"]
    rows = [(i, words[i % 4] + f" {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, None), (None, 1)], "doc_id long, quality int")
    one, other = (tx.labelled(spark.createDataFrame(r, "doc_id long, text string"), labels, "quality", fold=0, folds=5, limit=40) for r in (rows, rows + rows))
    plain = sorted((r.id, r.label, r.text) for r in one.collect())
    # labels without a document take no place in the sample; repeated rows count once
    assert len(plain) == 40 and plain == sorted((r.id, r.label, r.text) for r in other.collect())
    a, b = qc.train(one), qc.train(other)
    assert all((a[k] == b[k]).all() for k in a)
    assert [x.tolist() for x in tx.train(one)[:2]] == [x.tolist() for x in tx.train(other)[:2]]
    many = tx.labelled(spark.createDataFrame([(i, "t") for i in range(5000)], "doc_id long, text string"), spark.range(5000).selectExpr("id as doc_id", "1 as quality"), "quality", limit=300)
    chosen = {r.id for r in many.collect()}
    expected = [r.id for r in spark.range(5000).orderBy(F.xxhash64("id", F.lit(tx.SEED))).limit(300).collect()]
    assert chosen == set(expected)


def test_long_texts_are_learnt_from_as_a_whole(spark, monkeypatch):
    rnd = random.Random(4)
    text = " ".join("".join(rnd.choice("abcdeé,.") for _ in range(rnd.randrange(1, 9))) for _ in range(2000))
    for t in (text, "a" * 9000 + " b c", "," * 500, ""):
        whole = tx.features(t).tolist()
        for size in (3, 100, 4096):
            monkeypatch.setattr(tx, "PIECE", size)
            assert tx.features(t).tolist() == whole
            monkeypatch.undo()
    # a word that only long documents hold, far behind their start, tells toxic ones
    docs = spark.createDataFrame([(i, "plain words " * 9000 + ("vile" if i % 2 else "kind") + " plain words" * 3) for i in range(40)], "doc_id long, text string")
    labels = spark.range(40).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    monkeypatch.setattr(tx, "L1", 0.1)
    model = tx.train(tx.labelled(docs, labels, "toxic", fold=1, folds=3))
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in tx.scores(docs, model).collect())
    chunks = {r.at: r.bytes for r in qc.sampled_bytes(docs.selectExpr("doc_id as id", "text", "0 as label")).collect()}
    size = len(docs.first().text)
    assert len(chunks) == 40 and all(len(x) == (qc.MAX_TRAIN_CHUNKS - 1) * qc.CHUNK + size % qc.CHUNK and x.endswith(b" words") for x in chunks.values())


def test_network_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    net = qc.Net()
    net.p["out"] = rng.normal(0, 1, len(net.p["out"])).astype(np.float32)
    net.p["bias"] = rng.normal(0, 0.1, qc.FILTERS).astype(np.float32)
    texts = ["", "short", "Ünïcode ß " * 30, "a" * 512, "b" * 513, " ".join(str(i) for i in range(900)), None]
    got = {r.doc_id: r.score for r in qc.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net.p).collect()}
    filters = net.p["filters"].reshape(qc.WIDTH, qc.EMBED, qc.FILTERS)
    for i, text in enumerate(texts):
        b = (text or "").encode()
        pooled = []
        for start in range(0, max(len(b), 1), qc.CHUNK):
            chunk = list(b[start : start + qc.CHUNK + qc.WIDTH])
            chunk += [qc.PAD] * (qc.CHUNK + qc.WIDTH - len(chunk))
            best = np.full(qc.FILTERS, -np.inf)
            for at in range(0, qc.CHUNK, qc.STRIDE):
                y = np.zeros(qc.FILTERS)
                for k in range(qc.WIDTH):
                    y += net.p["embed"][chunk[at + k]] @ filters[k]
                best = np.maximum(best, y)
            pooled.append(np.maximum(best + net.p["bias"], 0))
        z = np.concatenate([np.mean(pooled, 0), np.max(pooled, 0)])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(z @ net.p["out"] + net.p["last"][0]))), abs=1e-4)


def test_ftrl_and_margins_against_dicts(spark):
    texts = [f"the {a} {b} thing" for a in ("bad", "good", "odd") for b in ("red", "blue", "bad")] * 2 + ["", "one"]
    labels = [1.0 if "bad" in t else 0.0 for t in texts]
    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, labels))], "id long, text string, label double")
    at, w, bias = tx.train(rows)
    order = [r.id for r in rows.orderBy(F.xxhash64("id", F.lit(tx.SEED))).collect()]
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= tx.L1 and k != "bias":
            return 0.0
        return -(z[k] - np.sign(z[k]) * tx.L1) / ((tx.BETA + n[k] ** 0.5) / tx.ALPHA + tx.L2)

    for _ in range(tx.EPOCHS):
        for i in order:
            keys = [*tx.features(texts[i]).tolist(), "bias"]
            was = {k: weight(k) for k in keys}
            g = 1 / (1 + np.exp(-sum(was.values()))) - labels[i]
            for k in keys:
                step = ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / tx.ALPHA
                z[k] += g - step * was[k]
                n[k] += g * g
    expected = {k: weight(k) for k in z if k != "bias" and weight(k)}
    assert set(at.tolist()) == set(expected) and np.allclose(w, [expected[k] for k in at.tolist()], atol=1e-6) and abs(bias - weight("bias")) < 1e-9
    table = np.zeros(1 << tx.BITS)
    table[at] = w
    sums = [sum(table[k] for k in tx.features(t)) for t in texts]
    assert np.allclose(tx.margins(pa.array(texts), table), sums)
    # the features of a text are those of a plain walk over its words
    words = "Bad-mood dog, Über".split(" ")
    assert len(tx.features("bad mood dog")) <= 3 + 3 * 3 + 2 + 1 and tx.features("BAD mood dog").tolist() == tx.features("bad, mood; dog!").tolist() and words
