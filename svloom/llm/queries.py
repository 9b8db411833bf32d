"""Queries of this package over the driver's tables, with the production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from svloom.llm import embedding_dedup, language_id, minhash, packing, prefix_trie, quality_classifier, quality_rules, sentencepiece_nbest, spelling, suffix_dedup, toxicity, url_filter, warc
from svloom.llm.shared import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.quality_rules(docs, trusted(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = toxicity.labelled(docs, table(spark, sf_dir, "labels"), "quality", fold=0, folds=5, limit=quality_classifier.MAX_TRAIN_DOCS)
    scored = quality_classifier.scores(docs, quality_classifier.train(labelled))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


#: Fixed rules: host, path prefix, action.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


OP7_SQL = """
with rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
hosts as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from rest),
parts as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from hosts),
rules(h, p, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
met as (select parts.page_id, parts.host, parts.path, h || p as rule, verdict,
  row_number() over (partition by parts.page_id order by length(h || p) desc, h || p) as k
  from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select parts.page_id, parts.host, parts.path, met.rule, coalesce(met.verdict, 'allow') as verdict
from parts left join met on met.page_id = parts.page_id and met.k = 1
"""

def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.train(table(spark, sf_dir, "documents"))
    return language_id.identify(table(spark, sf_dir, "pages"), model)


def toxicity_model(docs: DataFrame, labels: DataFrame):
    return toxicity.train(toxicity.labelled(docs, labels, "toxic", fold=1, folds=3))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.scores(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    ws = Workspace(spark, "trie")
    ids, turns = prefix_trie.rebuilt(conversations, prefix_trie.numbered_turns(ws, conversations))
    return prefix_trie.trie(ids, turns, ws)


#: crc32 of the bytes {bytes} (a list of numbers), by the table t of crcs, which its polynomial gives.
CRC_TABLE = """crcs as (select list(v order by i) as t from (select i, list_reduce(list_prepend(i::ubigint, range(8)::ubigint[]),
  lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as v from range(256) r(i)))"""
CRC = "xor(list_reduce(list_prepend(4294967295::ubigint, {bytes}::ubigint[]), lambda c, b: xor(c >> 8, t[(xor(c, b) % 256 + 1)::int])), 4294967295::ubigint)"

OP11_SQL = f"""
with {CRC_TABLE},
texts as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents where text is not null),
runs as (select doc_id, run, count(*) as k from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from texts) group by all),
hex as (select run, k, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from runs),
hashed as (select run, k, {CRC.format(bytes="list_transform(range(1, length(x) // 2 + 1), lambda i: 16 * (strpos('0123456789ABCDEF', x[2 * i - 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i]) - 1)")} as h from hex, crcs),
damaged as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from hashed),
words as materialized (select word, sum(k)::bigint as n, length(word) as len from damaged where length(word) >= 5 group by word having sum(k) >= 3),
cut as materialized (select word, n, len, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select *, unnest(range(1, len + 1)) as i from words)),
pairs as (select a.word, b.word as other, b.n as m from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from cut a join words b on a.rest = b.word
  union select b.word, a.word, a.n from cut a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, arg_max(other, (m, -rank)) as other, max(m) as m from (select *, row_number() over (order by other) as rank from pairs) group by word),
near as materialized (select words.word, n, coalesce(n_near, 0)::bigint as n_near, case when m >= 2 * n then other end as form, case when m >= 2 * n then m end as form_n from words left join best using (word)),
chain as (with recursive up as (select word, word as at from near union select up.word, near.form from up join near on near.word = up.at where near.form is not null) select up.word, up.at as root from up join near on near.word = up.at where near.form is null)
select near.word, n, n_near, form, form_n::bigint as form_n, root from near join chain using (word)
"""

OP12_SQL = """
with texts as materialized (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
pieces_of as (select r, doc_id, p, substr(x, 2 * p + 1, 610) as x from (select *, unnest(range(0, length(x) // 2 - 49, 256)) as p from texts)),
starts as materialized (select r, doc_id, p + i as i, substr(x, 2 * i + 1, 100) as s from (select *, unnest(range(0, least(length(x) // 2 - 49, 256))) as i from pieces_of)),
firsts as (select s, min(doc_id) as first from starts group by s),
hits as (select r, i from starts join firsts using (s) where doc_id > first),
marked as (select *, i - lag(i) over (partition by r order by i) as gap from hits),
islands as (select r, i, sum(case when gap <= 50 then 0 else 1 end) over (partition by r order by i) as k from marked),
spans as (select r, k, min(i) as a, max(i) + 50 as b from islands group by r, k),
kept as (select r, a, coalesce(lag(b) over (partition by r order by a), 0) as since, b from spans),
pieces as (select r, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' order by a) || substr(any_value(x), 2 * max(b) + 1) as x, sum(b - a) as gone, count(*) as spans from kept join texts using (r) group by r)
select doc_id, (length(texts.x) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(pieces.x, texts.x))) as kept_sha256
from texts left join pieces using (r)
"""

OP13_SQL = f"""
with {CRC_TABLE},
turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as d, role, text from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
ids as (select conv_id, {CRC.format(bytes="list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1)))")} % 6 as h from (select distinct conv_id from conversations where conv_id is not null), crcs),
built as materialized (select ids.conv_id, d, role, text from ids join turns on turns.conv_id = ids.conv_id - ids.conv_id % 100 and d <= h
  union all select ids.conv_id, d - h + least(h, (select count(*) from turns t where t.conv_id = ids.conv_id - ids.conv_id % 100)), role, text from ids join turns on turns.conv_id = ids.conv_id and d > h),
keyed as (select conv_id, d, length(text) as chars, sha256(length(role) || ':' || role || text) as key from built),
paths as (select conv_id, 0 as d, '' as path, 0 as chars from ids
  union all select conv_id, d, sha256(string_agg(key, '' order by d) over (partition by conv_id order by d rows between unbounded preceding and current row)), chars from keyed),
members as materialized (select conv_id, d, path, chars, min(conv_id) over (partition by d, path) as node, row_number() over (partition by conv_id order by d desc) = 1 as ends, lag(path) over (partition by conv_id order by d) as above from paths),
nodes as materialized (select d, path, node, any_value(above) as above, count(*) as n, (count(*) - 1) * any_value(chars) as saved, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '') as ids from members group by d, path, node),
kids as (select d - 1 as d, above as path, count(*) as k from nodes group by d, above),
full_nodes as materialized (select nodes.*, coalesce(kids.k, 0) as k, parents.node as parent from nodes left join kids on kids.d = nodes.d and kids.path = nodes.path left join nodes parents on parents.d = nodes.d - 1 and parents.path = nodes.above),
firsts as (select node as conv_id, d, path, saved, k from full_nodes),
sums as (select top.d, top.path, sum(below.saved) as saved, count(*) filter (where below.k = 0) as leaves
  from firsts below join members m on m.conv_id = below.conv_id and m.d <= below.d join full_nodes top on top.d = m.d and top.path = m.path group by top.d, top.path)
select f.node as conv_id, f.d::bigint as depth, f.parent as parent_conv_id, f.n::bigint as n_convs, f.k::bigint as n_children, sums.leaves::bigint as n_leaves, sums.saved::bigint as saved_tokens, sha256(f.ids) as ends_sha256
from full_nodes f join sums on sums.d = f.d and sums.path = f.path
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_minhash_near_dedup, op2_embedding_near_dedup, op3_packing, op4_quality_rules, op5_warc, op6_quality_classifier, op7_url_filter, op8_sentencepiece, op9_toxicity, op10_language_id, op11_spelling_variants, op12_suffix_array_dedup, op13_prefix_trie]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": OP7_SQL, "op11_spelling_variants": OP11_SQL, "op12_suffix_array_dedup": OP12_SQL, "op13_prefix_trie": OP13_SQL}
