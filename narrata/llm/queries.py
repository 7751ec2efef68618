"""The operators' registered queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm import decontaminate, hmm_lm, html_text, prefix_trie, quality, ring, secrets, sentencepiece_bpe, simhash, toxicity, vector_graph, warc, whitening
from narrata.llm.common import hashed_fold, table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of each vector whose id is divisible by 100."""
    return vector_graph.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark, with the items."""
    rows = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(F.col("id").alias("doc_id"), "item_id", "similarity", "cosine")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC files and read back."""
    path = warc.new_archive(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.archived(spark, path)


def piece_model() -> str:
    """The vocabulary file of the encoding queries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; each distinct word is checked against the library."""
    rows = sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), piece_model(), check=True, outputs=("digests",))
    return rows.withColumnRenamed("id", "doc_id")


def op6_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards whose row counts are at most one apart."""
    rows = ring.ring_shards(table(spark, sf_dir, "documents"), shards=40, load_factor=1.0)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a quarter of the ids are held out of the training."""
    rows = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held_out=2)
    held_out = hashed_fold(F.col("id"), 4) == 2
    return rows.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2)
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all kinds of secrets in every document."""
    rows = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.array(*(F.lit(r.kind) for r in secrets.BASE_RULES))

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    first = F.filter("spans", lambda s: F.array_contains(base, s["kind"]))
    counts = [count(r.kind) for r in secrets.BASE_RULES]
    return rows.select(F.col("id").alias("doc_id"), *counts, F.sha2(shown(first).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a third of the ids are held out of the training."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), folds=3, held_out=1)
    rows = toxicity.score_toxicity(docs, model)
    held_out = hashed_fold(F.col("id"), 3) == 1
    return rows.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "toxic_words", F.to_json("spans").alias("spans"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by single words and by the hidden Markov model; a fifth of the ids is held out."""
    return hmm_lm.hmm_scores(table(spark, sf_dir, "documents"), folds=5, held_out=1).withColumnRenamed("id", "doc_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitening components of every usable vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whitened(vectors, whitening.fit_whitening(vectors, components=4)).withColumnRenamed("id", "vec_id")


#: crc32 of the decimal number c in DuckDB: its bytes, each with eight steps of the reflected polynomial.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(c::varchar, ''), lambda d:
  [ascii(d)::bigint + 4294967296, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: case when b >= 0 then xor(a, b - 4294967296)
  else xor(a >> 1, (a & 1) * 3988292384) end), 4294967295)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html_text, op2_vector_graph, op3_decontamination, op4_warc, op5_sentencepiece, op6_ring_shards, op7_secret_scan, op8_quality, op9_simhash_near_dedup, op10_toxicity, op11_prefix_trie, op12_hmm_scores, op13_whitening)}

#: The other operators' results can't be written in SQL; they are tested against brute force, libraries or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op4_warc": """with p as (select page_id, coalesce(html, '') as html from pages),
w as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha256(html) as payload_digest, min(page_id) over (partition by html) as first from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id > first then first end as refers_to from w""",
    "op11_prefix_trie": f"""with own as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as p
  from conversations where conv_id is not null),
sized as (select c, count(*) as n, {_CRC32} % 6 as h, c - c % 100 as base from own group by c),
plan as (select s.c, s.h, s.base, least(s.h, coalesce(b.n, 0)) as taken from sized s left join sized b on b.c = s.base),
built as (select plan.c, own.p as d, role, text from plan join own on own.c = plan.base and own.p < plan.h
  union all select own.c, taken + own.p - h, role, text from own join plan on own.c = plan.c where own.p >= h),
paths as (select c, 0 as d, '' as path, 0 as size from plan union all
  select c, d + 1, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by c order by d), length(text) from built),
nodes as (select path, d, min(c) as conv, count(*) as n, any_value(size) as size from paths group by path, d),
up as (select v.*, a.path as parent from nodes v left join paths a on a.c = v.conv and a.d = v.d - 1),
kids as (select parent, d - 1 as d, count(*) as k from up where d > 0 group by 1, 2),
below as (select a.path, a.d, sum((v.n - 1) * v.size) as saved, count(*) filter (k.k is null) as leaves from nodes v
  left join kids k on k.parent = v.path and k.d = v.d join paths a on a.c = v.conv and a.d <= v.d group by 1, 2),
lasts as (select c, max(d) as d, arg_max(path, d) as path from paths group by c),
ends as (select path, d, string_agg(c::varchar, ',' order by c) as ids from lasts group by 1, 2)
select u.conv as conv_id, u.d::bigint as depth, q.conv as parent_conv_id, u.n as n_convs, coalesce(k.k, 0) as n_children, b.leaves as n_leaves,
  b.saved::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256 from up u left join nodes q on q.path = u.parent and q.d = u.d - 1
  left join kids k on k.parent = u.path and k.d = u.d join below b on b.path = u.path and b.d = u.d left join ends e on e.path = u.path and e.d = u.d""",
}
