"""WARC bundles, URL filters and the corpus pipeline."""

import base64
import hashlib
import math
import random
import time

import pytest

import corpus_pipeline
from svloom.llm import minhash as mh, queries, toxicity, url_filter as uf, warc
from svloom.llm.shared import Workspace

PAGES = [(1, "http://a.com/", "<p>same</p>"), (5, "http://b.com/x\r\ny", "<p>same</p>"), (3, None, "<p>same</p>"), (4, "http://ü.de/", "日本"), (7, "u", None), (8, "u", ""), (None, "u", "<p>same</p>"), (9, "u", "x" * 3_000_000), (4, "http://ü.de/", "日本")]


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)


def test_warc_round_trip(spark, pages):
    got = sorted(map(str, (tuple(r) for r in warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())))
    first = {"<p>same</p>": 1, "日本": 4, "": 7, "x" * 3_000_000: 9}
    expected = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        of = first[html or ""]
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == of else "revisit", None if i == of else of))
    assert got == sorted(map(str, expected))
    assert warc.archive(pages.limit(0)).count() == 0


def test_small_payloads_are_not_shared(spark, pages):
    kinds = {r.page_id: r.record_type for r in warc.archive(pages, min_bytes=100).collect()}
    assert set(kinds.values()) == {"response"}


def test_random_access_by_the_index(spark, pages):
    ws = Workspace(spark, "test")
    for r in warc.write_archives(pages, ws).collect():
        bundle = warc.Bundle(r.bundle)
        head, payload = bundle.record(r.frame, r.offset)
        assert head["WARC-Record-ID"] == warc._name(r.page_id)
        html = next(p[2] for p in PAGES if p[0] == r.page_id)
        assert payload == (b"" if head["WARC-Type"] == "revisit" else (html or "").encode())
    import zstandard

    whole = b""
    with zstandard.ZstdDecompressor().stream_reader(bundle.file.read_at(bundle.file.size(), 0), read_across_frames=True) as reader:
        whole = reader.read()
    assert len(list(warc.parse(whole))) >= 1


def test_url_rules_against_plain_loop(spark):
    rnd = random.Random(4)
    hosts = ["com", "example.com", "a.example.com", "badexample.com", "net", "x.net", "example.net", "www.example.net", "org", "EXAMPLE.ORG", "", "a..com"]
    paths = ["", "/", "/en/", "/en/7", "/en/71?x=/de/", "/de/8#q", "/de/", "/es/1", "/en"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/en/", "a://b://com/en/", "http://com?/en/", "http://u@com:80/en/"]
    rnd.shuffle(urls)
    rows = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    for r in uf.judge(rows, queries.URL_RULES, ["x.net/"]).collect():
        host, path = uf.parts(urls[r.page_id])
        fits = [(len(h + p), h + p, a) for h, p, a in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == (best[2] if best else "block" if host + path == "x.net/" else "allow")
    assert uf.judge(rows.limit(0), queries.URL_RULES).count() == 0


def test_long_hosts_and_many_listed_urls(spark):
    rules = queries.URL_RULES
    host = "a." * 100_000 + "example.com"
    assert len(uf.candidates(host, "/en/7", uf.shapes(rules))) <= 4
    listed = [f"h{k % 1000}.test/{k}" for k in range(200_000)]
    urls = [f"http://{host}/en/7", f"http://{host}/en/1", "http://x.net/" + "p" * 1_000_000, "http://h5.test/100005", "http://h5.test/100006"]
    began = time.perf_counter()
    rows = uf.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, listed).collect()
    assert [r.verdict for r in sorted(rows)] == ["allow", "block", "allow", "block", "allow"] and time.perf_counter() - began < 60


def test_digest_collisions_are_told_by_their_strings(tmp_path, monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s: len(s))
    (tmp_path / "f").write_bytes(uf.DigestArray.layout({"ab": 1, "cd": 0, "xyz": 2}))
    assert uf.DigestArray(str(tmp_path / "f")).find([b"cd", b"ab", b"ef", b"xyz", b"q"]).tolist() == [0, 1, -1, 2, -1]
    (tmp_path / "g").write_bytes(uf.DigestArray.layout({}))
    assert uf.DigestArray(str(tmp_path / "g")).find([b"a"]).tolist() == [-1]


def test_url_query_equals_its_sql(spark, duck, sf):
    got = queries.op7_url_filter(spark, sf)
    cols = sorted(got.columns)
    expected = duck.sql(queries.OP7_SQL).project(", ".join(cols)).fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(str, expected))


def test_pipeline_stages(spark, sf):
    docs = queries.table(spark, sf, "documents")
    ws = Workspace(spark, "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = ws.table(stage(spark, docs, sf), name)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
    whole = {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(r.kept for r in mh.near_duplicates(docs).collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == whole


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_dedup_stage_keeps_one_of_repeated_rows(spark, sf):
    a, b = " ".join(f"w{k}" for k in range(30)), "other words that are no copy of it"
    cases = [
        ([(1, a), (1, a), (2, a), (3, None)], [(1, a), (3, None)]),
        ([(1, a), (5, a), (5, b), (None, a)], [(1, a), (5, b)]),  # a text of its own under a copy's id stays; a copy without id goes
        ([(None, a), (None, a), (None, b), (None, None), (None, "")], [(None, a), (None, b), (None, None)]),
        ([(4, ""), (4, None), (4, " "), (6, None)], [(4, ""), (4, " "), (6, None)]),
        ([(5, a), (5, a.upper()), (5, a + " g"), (5, b)], [(5, a), (5, b)]),
        ([], []),
    ]
    for rows, expected in cases:
        docs = spark.createDataFrame([(*r, "en", "s", 11) for r in rows], COLUMNS)
        left = [(r.doc_id, (r.text or "").lower().removesuffix(" g")) for r in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()]
        assert sorted(map(str, left)) == sorted(str((i, t or "")) for i, t in expected)


def test_stages_on_odd_rows(spark, sf):
    """Each stage on nulls, repeats and an empty table: what it keeps, it keeps as it was."""
    clean = " ".join(f"plain{i % 70} words{i % 90}" for i in range(300))
    rows = [(1, clean, "en", None, 1), (1, clean, "en", None, 1), (None, clean, None, "s", None), (2, None, "en", "s", 0), (3, "", None, None, None), (4, clean * 200, "en", "s", 9)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, sf)
        assert left.columns == docs.columns and {tuple(r) for r in left.collect()} <= set(rows)
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.toxicity_stage(spark, docs, sf).count() == len(rows)
    packed = corpus_pipeline.packing_stage(spark, docs, sf).collect()
    assert all(len(r.ids) == r.length for r in packed) and corpus_pipeline.packing_stage(spark, docs.limit(0), sf).count() == 0


def test_toxicity_and_quality_stages_against_their_operators(spark, sf):
    docs = queries.table(spark, sf, "documents")
    model = queries.toxicity_model(docs, queries.table(spark, sf, "labels"))
    weights = dict(zip(model[0].tolist(), model[1].tolist()))
    rows = docs.collect()
    margin = {r.doc_id: model[2] + sum(weights.get(k, 0.0) for k in toxicity.features(r.text).tolist()) for r in rows}
    expected = {i for i, m in margin.items() if 1 / (1 + math.exp(-m)) < toxicity.THRESHOLD}
    assert {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, sf).collect()} == expected
    kept = {r.doc_id for r in queries.op4_quality_rules(spark, sf).where("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, sf).collect()} == kept
