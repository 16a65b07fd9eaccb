"""The registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hmm, language_id, lexical_search, mixing, ogg, packing, sharding, simhash, substring_dedup, toxicity, vector_codes, vector_search, warc

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.from_media(ogg.to_media(table(spark, sf_dir, "documents")))


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vector_search.search(rows, rows.filter(F.col("vec_id") % 20 == 0))


def substring_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.read_warc(warc.archive(table(spark, sf_dir, "pages")))
    return rows.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def vector_codes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def language_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_hmm_scoring": lm_scoring,
    "op2_simhash_near_dedup": simhash_near_dedup,
    "op3_differencing_packing": pack_sequences,
    "op4_ogg_media": ogg_media,
    "op5_entropy_balanced_mixing": mix_sources,
    "op6_noisy_channel_toxicity": toxicity_scores,
    "op7_balanced_posting_search": nearest_neighbours,
    "op8_difference_cover_dedup": substring_repeats,
    "op9_differencing_shards": byte_shards,
    "op10_arc_to_warc": arc_to_warc,
    "op11_weighted_lloyd_codes": vector_codes_of,
    "op12_language_bitmask_filters": language_of,
    "op13_dual_sorted_search": ranked_search,
}

_WORDS = r"""list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

SUBSTRING_SQL = f"""
with words as materialized (
  select doc_id, {_WORDS} as w from documents
), numbered as materialized (select row_number() over () as r, doc_id, w, len(w) as n from words),
windows as materialized (
  select r, s, md5(array_to_string(w[s : s + 34], ' ')) as h
  from (select r, w, unnest(range(1, n - 33)) as s from numbered where n >= 35)
), repeated as (
  select r, s from (select r, s, count(*) over (partition by h) as c from windows) where c > 1
), gone as (select distinct r, unnest(range(s, s + 35)) as p from repeated),
lost as (select r, list(p order by p) as ps, count(*) as k from gone group by r)
select doc_id, n as n_words, coalesce(k, 0) as n_removed,
  sha256(array_to_string(case when k is null then w else
    list_transform(list_filter(range(1, n + 1), lambda i: not list_contains(ps, i)), lambda i: w[i]) end, ' ')) as kept_sha256
from numbered left join lost using (r)
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(((('0x' || substr(d, {1 + 10 * (i // 8)}, 10))::bigint >> {35 - 5 * (i % 8)}) & 31) as integer), 1)" for i in range(32)
)

WARC_SQL = f"""
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, h, octet_length(encode(h)) as payload_bytes, sha1(h) as d, max(page_id) over (partition by h) as top from p)
select page_id, payload_bytes, {_BASE32} as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to
from q
"""

_PARTS, _ENTRIES, _ROUNDS = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS


def _assigned(book: str) -> str:
    """Each part with its nearest entry of ``book``; products of these integers are exact in doubles."""
    return f"""(select id, pos, v, n, e, d from (select p.id, p.pos, p.v, p.n, b.e, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))::bigint as d
    from parts p join {book} b using (pos)) qualify row_number() over (partition by id, pos order by d, e) = 1)"""


def _round(i: int) -> str:
    return f"""got{i} as materialized (select pos, e, nth, floor(sum(n * v[nth])::double / sum(n))::bigint as x from (select *, unnest(range(1, len(v) + 1)) as nth from {_assigned(f"book{i}")}) group by pos, e, nth),
  book{i + 1} as materialized (select b.pos, b.e, coalesce(g.v, b.v) as v from book{i} b left join (select pos, e, list(x order by nth) as v from got{i} group by pos, e) g using (pos, e))"""


CODES_SQL = f"""with kept as materialized (select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
    from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  cut as materialized (select r, pos, v[pos * len(v) // {_PARTS} + 1 : (pos + 1) * len(v) // {_PARTS}] as v from kept, (select unnest(range({_PARTS})) as pos)),
  parts as materialized (select row_number() over () as id, pos, v, count(*) as n from cut group by pos, v),
  book0 as materialized (select pos, r - 1 as e, v from cut where r <= {_ENTRIES}),
  {", ".join(_round(i) for i in range(_ROUNDS))},
  coded as materialized (select r, string_agg(lpad(format('{{:x}}', e), 2, '0'), '' order by pos) as code, sum(d)::bigint as error from cut join {_assigned(f"book{_ROUNDS}")} using (pos, v) group by r),
  books as (select sha256(string_agg(array_to_string(v, ','), ',' order by pos, e)) as h from book{_ROUNDS})
  select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from kept join coded using (r), books"""

def _terms(c: str) -> str:
    return f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical_search.TERM}')"


LEXICAL_SQL = f"""with d as materialized (select row_number() over () as r, doc_id, {_terms("text")} as t from documents),
  tf as materialized (select r, t, count(*) as tf from (select r, unnest(t) as t from d) group by r, t),
  st as (select count(*)::bigint as docs, sum(len(t))::bigint as terms from d where len(t) > 0),
  m as materialized (select r, doc_id, 75 + (25 * len(t) * docs) // terms as m from d, st where len(t) > 0),
  w as materialized (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, st group by t, docs),
  asked as (select b, item_id, t, count(*)::bigint as times from (select row_number() over () as b, item_id, unnest({_terms("text")}) as t from benchmark) group by b, item_id, t),
  s as (select b, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score from asked join w using (t) join tf using (t) join m using (r) group by b, item_id, r, doc_id)
  select item_id, rank, doc_id, score from (select *, row_number() over (partition by b order by score desc, doc_id nulls last)::integer as rank from s where score > 0) where rank <= {lexical_search.TOP}"""

ORACLE_SQL = {
    "op13_dual_sorted_search": LEXICAL_SQL,
    "op11_weighted_lloyd_codes": CODES_SQL,
    "op8_difference_cover_dedup": SUBSTRING_SQL,
    "op10_arc_to_warc": WARC_SQL,
}
