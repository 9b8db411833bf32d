"""Language ID by Bayesian fusion of four kinds of evidence about a page.

* Text: log-likelihoods of hashed byte trigrams of the visible text under each language, learnt on a bounded sample
  of documents with a known language; divided by the square root of their number, as neighbouring trigrams are far
  from independent.
* Declared language: the lang attribute of the html element, right with probability DECLARED.
* Address suffix: country suffixes that speak for a language, right with probability SUFFIX.
* Host: how often the other pages of the host have each language, smoothed towards its domain (last two labels),
  that towards its last label, that towards all pages; counted by grouped aggregation of the pages' text votes.
  A page's own vote is taken out of all its counts.

A declared language counts by its primary code (three-letter codes of known languages become two letters).
The posterior is the normalised product. Ties go to the language first in order. Null html or url count as empty:
the page then has no evidence of that kind; a page without any gets the prior of all pages. Repeated rows vote
repeatedly. Other columns are not read. Without any training document every language is null. A page of any length is
read whole, in memory in proportion to it. An empty table gives an empty result.
"""

from __future__ import annotations

import html as htmllib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from svloom.llm import bytewords as bw
from svloom.llm.shared import Workspace, sample_ids

BITS = 16
#: Bound of the training sample; its texts are counted whole.
MAX_TRAIN_DOCS = 4_000
DECLARED, SUFFIX = 0.9, 0.8
#: Weight of the level above, in pages, when a level's counts are smoothed.
SMOOTH = 5.0
#: Fixed: country suffixes and their languages.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
#: Fixed: three-letter codes of languages that have two-letter ones here.
CODES = {"deu": "de", "ger": "de", "eng": "en", "fra": "fr", "fre": "fr", "spa": "es"}
TAG = re.compile(r"<[^<>]*>")
HIDDEN = re.compile(r"<(script|style)(?=[\s/>])|<!--", re.I | re.A)
CLOSED = {None: re.compile("-->"), "script": re.compile(r"</script", re.I | re.A), "style": re.compile(r"</style", re.I | re.A)}
ROOT = re.compile(r"<html(?=[\s/>])", re.I | re.A)
ATTRIBUTE = re.compile(r"""[\s/]*([^\s=>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")


def shown(html: str) -> str:
    """The page without comments, scripts and styles; what is never closed goes to the end."""
    out, at = [], 0
    while found := HIDDEN.search(html, at):
        out.append(html[at : found.start()])
        kind = found[1] and found[1].lower()
        stop = CLOSED[kind].search(html, found.end())
        at = len(html) if stop is None else stop.start() if kind else stop.end()
    return "".join(out) + html[at:]


def visible(html: str) -> str:
    """Text outside of tags, comments, scripts and styles."""
    return htmllib.unescape(TAG.sub(" ", shown(html))) if "<" in html or "&" in html else html


def declared(html: str) -> str | None:
    """Primary language of the lang attribute of the first html element, two letters where there are such."""
    html = shown(html)
    root = ROOT.search(html)
    at = root.end() if root else len(html)
    while found := ATTRIBUTE.match(html, at):
        at = found.end()
        if found[1].lower() == "lang":
            code = re.match(r"\s*([A-Za-z]+)", found[2] or found[3] or found[4] or "")
            return CODES.get(code[1].lower(), code[1].lower()) if code else None
    return None


def trigrams(text: str) -> np.ndarray:
    b = bw.LOWER[np.frombuffer(text.encode(errors="replace"), np.uint8)].astype(np.uint64)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return (bw.mix(b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def train(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of each bucket under each) from ``docs`` (doc_id, text, lang), at most ``max_docs`` of them.

    Ids are chosen first, without texts; the executors count the chosen texts, and the driver gets sums. Of several
    documents with one id the least language and text count.
    """
    spark = docs.sparkSession
    usable = docs.where("doc_id is not null and lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), "lang", "text")
    ws = Workspace(spark, "language")
    chosen = sample_ids(ws.table(usable.select("id").distinct(), "ids"), max_docs, 10)

    def apply(batches):
        for batch in batches:
            counts: dict[str, np.ndarray] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                at, n = np.unique(trigrams(text), return_counts=True)
                counts.setdefault(lang, np.zeros(1 << BITS, np.int64))[at] += n
            for lang, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])], names=["lang", "bucket", "n"])

    few = usable.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("lang", "text")).alias("x"))
    few = ws.table(few.select("x.lang", "x.text"), "sample")
    seen = few.select("lang").distinct().toArrow().column("lang").to_pylist()
    langs = sorted(seen)
    if not langs:
        return [], np.zeros((0, 1 << BITS))
    sums = few.mapInArrow(apply, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    c = np.full((len(langs), 1 << BITS), 0.5)
    number = {x: k for k, x in enumerate(langs)}
    c[[number[x] for x in sums.column("lang").to_pylist()], sums.column("bucket").to_numpy()] += sums.column("n").to_numpy()
    return langs, np.log(c / c.sum(1, keepdims=True))


def evidence(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(page_id, host, domain, suffix, declared, text: log-likelihoods, vote: best language's number, -1 without text)."""
    langs, table = model
    table = (table - table.mean(0) if len(langs) else table).astype(np.float32)

    def apply(batches):
        for batch in batches:
            rows = []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                _, mark, rest = (url or "").partition("://")
                host = re.split(r"[/?#:]", rest, maxsplit=1)[0].lower() if mark else ""
                labels = host.split(".")
                at = trigrams(visible(page or ""))
                text = [float(x) for x in table[:, at].sum(1, dtype=np.float64) / np.sqrt(len(at))] if len(at) and langs else [0.0] * len(langs)
                vote = int(np.argmax(text)) if len(at) and langs else -1
                rows.append((host, ".".join(labels[-2:]), labels[-1], declared(page or ""), text, vote))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.string()] * 4 + [pa.list_(pa.float64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["page_id", "host", "domain", "suffix", "declared", "text", "vote"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(apply, "page_id long, host string, domain string, suffix string, declared string, text array<double>, vote int")


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(page_id, host, declared, lang, posterior, text_lang) of each page."""
    langs = model[0]
    n = len(langs)
    spark = pages.sparkSession
    ws = Workspace(spark, "language")
    seen = ws.table(evidence(pages, model), "evidence")
    if not n:
        null = F.lit(None).cast("string")
        return seen.select("page_id", "host", "declared", null.alias("lang"), F.lit(None).cast("double").alias("posterior"), null.alias("text_lang"))
    votes = F.array(*[F.count(F.when(F.col("vote") == k, 1)).cast("double") for k in range(n)])
    per_host = ws.table(seen.groupBy("host", "domain", "suffix").agg(votes.alias("host_votes")), "hosts")
    add = lambda name: F.array(*[F.sum(F.get(name, F.lit(k))) for k in range(n)])
    per_domain = per_host.groupBy("domain", "suffix").agg(add("host_votes").alias("domain_votes"))
    per_domain = ws.table(per_domain, "domains")
    per_suffix = ws.table(per_domain.groupBy("suffix").agg(add("domain_votes").alias("suffix_votes")), "suffixes")
    every = [x or 0.0 for x in per_suffix.agg(add("suffix_votes").alias("v")).first()["v"]]
    levels = per_host.join(per_domain, ["domain", "suffix"]).join(per_suffix, "suffix").select("host", "host_votes", "domain_votes", "suffix_votes")
    levels = ws.table(levels, "levels")
    met = seen.join(levels, "host")
    names = F.array(*[F.lit(x) for x in langs])
    own = lambda k: F.when(F.col("vote") == k, 1.0).otherwise(0.0)

    def smoothed(k: int) -> Column:
        up = (F.lit(float(every[k])) - own(k) + 1.0) / (F.lit(float(sum(every))) - F.when(F.col("vote") >= 0, 1.0).otherwise(0.0) + n)
        for level in ("suffix_votes", "domain_votes", "host_votes"):
            total = F.aggregate(level, F.lit(0.0), lambda a, x: a + x) - F.when(F.col("vote") >= 0, 1.0).otherwise(0.0)
            up = (F.get(level, F.lit(k)) - own(k) + SMOOTH * up) / (total + SMOOTH)
        return up

    said = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    points_to = F.try_element_at(said, F.col("suffix"))

    def given(what: Column, k: int, right: float) -> Column:
        """Log probability of naming a known language, given language k."""
        known = F.coalesce(F.array_contains(names, what), F.lit(False))
        return F.when(known, F.when(what == langs[k], F.log(F.lit(right))).otherwise(F.log(F.lit((1 - right) / max(1, n - 1))))).otherwise(0.0)

    score = F.array(*[F.get("text", F.lit(k)) + given(F.col("declared"), k, DECLARED) + given(points_to, k, SUFFIX) + F.log(smoothed(k)) for k in range(n)])
    met = met.select("page_id", "host", "declared", "vote", score.alias("s"))
    best = F.array_position("s", F.array_max("s")).cast("int")
    posterior = 1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("s")))
    text_lang = F.when(F.col("vote") >= 0, F.get(names, F.col("vote")))
    return met.select("page_id", "host", "declared", F.get(names, best - 1).alias("lang"), posterior.alias("posterior"), text_lang.alias("text_lang"))
