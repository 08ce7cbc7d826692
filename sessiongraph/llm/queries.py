"""The registered queries of the operators, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessiongraph.llm import (
    context_mixing,
    decontamination,
    exact_search,
    html_text,
    language_id,
    lexical_search,
    licenses,
    near_duplicates,
    secrets,
    sentence_pieces,
    sharding,
    token_alignment,
    vector_duplicates,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHARDS = 16
VECTOR = "embedding"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_model() -> str:
    return tokenizer_file("piece_bpe_32k.model")


SHARD_SQL = f"""
with keyed as (
    select doc_id, text, coalesce(cast(doc_id as varchar), 'null') as k from documents
), scored as (
    select doc_id, text, k, s,
        -1.0 / ln((cast(('0x' || substr(md5(k || ':' || s), 1, 12)) as bigint) + 0.5) / 281474976710656.0) as w
    from keyed, range({SHARDS + 1}) r(s)
), placed as (
    select doc_id, text, k, arg_max(s, w) filter (s < {SHARDS}) as shard, arg_max(s, w) as grown_shard
    from scored group by all
), numbered as (
    select *, greatest(1, (select ceil(count(*) / {sharding.ROWS_PER_BUCKET}.0) from documents)) as n_buckets,
        (cast(('0x' || substr(md5(k), 1, 12)) as bigint) + 0.5) / 281474976710656.0 as u
    from placed
), checksums as (
    select text as t, list_reduce(
        list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(hex(encode(text)), '..'),
            lambda h: ('0x' || h)::ubigint)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::ubigint[]),
            lambda x, i: xor(x >> 1, 3988292384::ubigint * (x & 1)))) as crc
    from (select distinct text from documents where text <> '')
)
select doc_id, coalesce(octet_length(encode(text)), 0) + 1 as size,
    coalesce(xor(crc, 4294967295::ubigint), 0)::bigint as text_crc32, 'key' as law, shard::int as shard,
    row_number() over (partition by shard order by floor(u * n_buckets), doc_id) - 1 as slot,
    grown_shard::int as grown_shard
from numbered left join checksums on t = text
"""

TOP_K_SQL = f"""
with v as (
    select vec_id, list_transform({VECTOR}, lambda x: floor(256 * x::double)::bigint) as e from embeddings
    where {VECTOR} is not null and len(list_filter({VECTOR}, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
    from v q, v c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 5
"""

_WORDS = "regexp_split_to_array(lower({0}), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
_RUNS = "list_distinct(list_transform(range(1, len({0}) - 1), lambda i: {0}[i] || ' ' || {0}[i + 1] || ' ' || {0}[i + 2]))"
LICENSE_SQL = f"""
with notices(notice, license, t) as (values {", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(licenses.NOTICES))}),
nw as (select notice, license, {_WORDS.format("t")} as w from notices),
ns as (select notice, license, unnest({_RUNS.format("w")}) as s, len({_RUNS.format("w")}) as n_shingles from nw),
dw as (select doc_id, {_WORDS.format("text")} as w from documents where text <> ''),
ds as (select doc_id, unnest({_RUNS.format("w")}) as s from dw where len(w) >= 3)
select doc_id, license, notice::int as notice, count(*)::int as matched, n_shingles::int as n_shingles
from ds join ns using (s) group by doc_id, license, notice, n_shingles
having count(*) >= n_shingles * {licenses.CONTAINMENT} - 1e-9
"""

JACCARD_SQL = """
with recursive w as (
    select doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+'), lambda x: x <> '') as words
    from documents where text is not null
), s as (
    select distinct doc_id, unnest(case when len(words) = 0 then []
        when len(words) < 5 then [array_to_string(words, ' ')]
        else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) end) as g from w
), n as (select doc_id, count(*) as n from s group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
links as (
    select a, b, k = x.n and k = y.n as same from common join n x on x.doc_id = a join n y on y.doc_id = b
    where k >= 0.8 * (x.n + y.n - k) - 1e-9
), reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on l.a = r.b)
select d.doc_id, coalesce(n.n, 0)::int as n_shingles, (select min(b) from reach r where r.a = d.doc_id) as class_id,
    least(d.doc_id, coalesce((select min(b) from links l where l.a = d.doc_id and same), d.doc_id)) as rep_id,
    1 + (select count(*) from links l where l.a = d.doc_id and same) as copies,
    (select count(*) from links l where l.a = d.doc_id) as n_links
from documents d left join n on n.doc_id = d.doc_id
"""


_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
RANK_SQL = f"""
with d as (
    select row_number() over () as r, doc_id, {_TERMS} as t from documents where text is not null
), totals as (select count(*) as docs, sum(len(t))::bigint as terms from d where len(t) > 0),
asked as (select distinct item_id, unnest({_TERMS}) as term from benchmark where item_id is not null),
tf as (select r, doc_id, len(t) as n, unnest(t) as term from d where len(t) > 0),
counted as (
    select r, doc_id, n, term, count(*) as tf from tf where term in (select term from asked) group by all
), weights as (
    select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
    from (select term, count(*) as df from counted group by 1), totals
), scored as (
    select item_id, r, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::bigint as score
    from asked join counted using (term) join weights using (term), totals
    where doc_id is not null group by 1, 2, 3
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 10
"""

NEAR_VECTORS_SQL = f"""
with recursive v as (
    select vec_id, list_transform({VECTOR}, lambda x: x::double) as e from embeddings
    where {VECTOR} is not null and len(list_filter({VECTOR}, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter({VECTOR}, lambda x: x <> 0)) > 0
), links as (
    select a.vec_id as a, b.vec_id as b from v a, v b
    where a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= {vector_duplicates.SIMILARITY}
), reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select a as vec_id, min(b) as component_id from reach group by 1),
linked as (select a as vec_id, count(*) as n_links from links group by 1)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join least using (vec_id) left join linked using (vec_id)
"""


@query("op1_language_id")
def identify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_id.train(documents.where(~language_id.held_out()))
    found = language_id.identify(documents, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rate", "n_letters")


@query("op2_license_scan", LICENSE_SQL)
def scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op3_ngram_jaccard_join", JACCARD_SQL)
def join_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_sharding", SHARD_SQL)
def shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


@query("op5_lm_scoring")
def score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = context_mixing.held_out()
    model, tokens = context_mixing.train(documents.where(~held_out))
    scored = context_mixing.score(documents, model, tokens, trained=~held_out)
    first = ["doc_id", held_out.alias("held_out")]
    return scored.select(*first, *[c for c in scored.columns if c != "doc_id"])


@query("op6_html_extraction")
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query("op7_secret_scan")
def scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = secrets.find_candidates(documents, path_column="source")
    forest = secrets.train(secrets.label_by_rules(found))
    return secrets.scan(documents, forest, path_column="source")


@query("op8_sentence_pieces")
def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_documents(table(spark, sf_dir, "documents"), piece_model())


@query("op9_exact_top_k", TOP_K_SQL)
def search_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_search.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5, "vec_id", VECTOR)


@query("op10_benchmark_decontamination")
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_lexical_search", RANK_SQL)
def rank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


@query("op12_token_alignment")
def align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(
        table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), piece_model()
    )


@query("op13_vector_duplicates", NEAR_VECTORS_SQL)
def find_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates.near_duplicate_vectors(
        table(spark, sf_dir, "embeddings"), id_column="vec_id", vector_column=VECTOR
    )
