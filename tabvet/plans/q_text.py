"""Registered K-series (text, retrieval, chat) and B8 queries with their DuckDB oracles.

Corpus = `documents` (chunked), query set = `benchmark`, vectors = `embeddings` searched from
their per-label centroids, chat = `conversations`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions.core import round_doubles
from tabvet.operators import text as K
from tabvet.plans.registry import query
from tabvet.plans.sqlgen import r6, with_
from tabvet.sources.tables import load_table

TOK = "regexp_extract_all(lower({x}), '[a-zA-Z0-9_]+')"
NORM = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"

CHUNKS_SQL = [f"""dn AS (SELECT doc_id, source, {NORM.format(x='text')} AS t FROM documents)""",
              """chunks AS (SELECT doc_id, source, chunk_start, substring(t, CAST(chunk_start AS BIGINT) + 1, 750) AS chunk FROM (
   SELECT doc_id, source, t, unnest(generate_series(0, CASE WHEN length(t) <= 750 THEN 0 ELSE CAST(ceil((length(t) - 750) / 600.0) AS BIGINT) * 600 END, 600)) AS chunk_start
   FROM dn WHERE length(t) > 0))"""]


def chunks_df(spark, d):
    return K.chunk_chars(load_table(spark, d, "documents"), keep=["doc_id", "source"])


def queries_df(spark, d):
    return load_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("k1_normalize_ws", f"""SELECT doc_id, length({NORM.format(x='text')}) AS n_chars_normalized,
  CASE WHEN regexp_replace(regexp_replace(source || '/' || lang, '[^a-zA-Z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN 'document'
       ELSE regexp_replace(regexp_replace(source || '/' || lang, '[^a-zA-Z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') END AS slug FROM documents""")
def k1_normalize_ws(spark, d):
    doc = load_table(spark, d, "documents")
    return doc.select("doc_id", F.length(K.normalize_ws(F.col("text"))).alias("n_chars_normalized"),
                      K.slug(F.concat_ws("/", "source", "lang")).alias("slug"))


@query("k2_tokenize", f"""SELECT doc_id, CAST(len({TOK.format(x='text')}) AS INTEGER) AS n_tokens,
  CAST(len(list_distinct({TOK.format(x='text')})) AS INTEGER) AS n_unique_tokens FROM documents""")
def k2_tokenize(spark, d):
    doc = load_table(spark, d, "documents")
    t = K.tokenize(F.col("text"))
    return doc.select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_unique_tokens"))


@query("k3_chunk_chars", with_(CHUNKS_SQL, "SELECT doc_id, source, chunk_start, chunk FROM chunks"))
def k3_chunk_chars(spark, d):
    return chunks_df(spark, d)


@query("k4_chunk_words", """WITH w AS (SELECT doc_id, CASE WHEN trim(text) = '' THEN [] ELSE string_split_regex(trim(text), '\\s+') END AS words FROM documents),
c AS (SELECT doc_id, words, CAST(ceil(len(words) / 450.0) AS INTEGER) AS total_chunks FROM w WHERE len(words) > 0),
e AS (SELECT doc_id, words, total_chunks, CAST(unnest(generate_series(0, total_chunks - 1)) AS INTEGER) AS chunk FROM c)
SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) || '_' || CAST(chunk AS VARCHAR) AS chunk_id, chunk, total_chunks,
  array_to_string(words[chunk * 450 + 1 : chunk * 450 + 500], ' ') AS text FROM e""")
def k4_chunk_words(spark, d):
    return K.chunk_words(load_table(spark, d, "documents"))


KW_SQL = CHUNKS_SQL + [
    f"""q AS (SELECT item_id AS query_id, list_distinct({TOK.format(x='text')}) AS qt FROM benchmark)""",
    f"""dt AS (SELECT doc_id, chunk_start, list_distinct({TOK.format(x='chunk')}) AS dt FROM chunks)""",
    """pr AS (SELECT query_id, doc_id, chunk_start, len(list_intersect(qt, dt)) AS overlap, len(qt) AS nq, len(dt) AS nd FROM q, dt WHERE len(qt) > 0 AND len(dt) > 0)""",
    """sc AS (SELECT query_id, doc_id, chunk_start, CAST(overlap AS INTEGER) AS overlap, overlap / nq + overlap / sqrt(nd) AS score FROM pr WHERE overlap > 0)""",
    """kw AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_start) AS INTEGER) AS rank FROM sc) WHERE rank <= 5)"""]


def kw_results(spark, d):
    return K.keyword_search(queries_df(spark, d), chunks_df(spark, d).select("doc_id", "chunk_start", "chunk"), k=5)


@query("k5_keyword_search", with_(KW_SQL, f"SELECT query_id, doc_id, chunk_start, overlap, {r6('score')} AS score, rank FROM kw"))
def k5_keyword_search(spark, d):
    return round_doubles(kw_results(spark, d))


TF_SQL = [f"""qtok AS (SELECT item_id AS query_id, unnest({TOK.format(x='text')}) AS tok FROM benchmark)""",
          """qm AS (SELECT query_id, tok, count(*) AS m FROM qtok GROUP BY 1, 2)""",
          f"""dtok AS (SELECT doc_id, chunk_start, unnest({TOK.format(x='chunk')}) AS tok FROM chunks)""",
          """dm AS (SELECT doc_id, chunk_start, tok, count(*) AS c FROM dtok GROUP BY 1, 2, 3)""",
          """tf AS (SELECT query_id, doc_id, chunk_start, CAST(sum(m * c) AS BIGINT) AS tf FROM qm JOIN dm USING (tok) GROUP BY 1, 2, 3)""",
          """tft AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tf DESC, doc_id, chunk_start) AS INTEGER) AS rank FROM tf) WHERE rank <= 5)"""]


def tf_results(spark, d):
    return K.term_frequency_search(queries_df(spark, d), chunks_df(spark, d).select("doc_id", "chunk_start", "chunk"), k=5)


@query("k7_term_frequency_search", with_(CHUNKS_SQL + TF_SQL, "SELECT query_id, doc_id, chunk_start, tf, rank FROM tft"))
def k7_term_frequency_search(spark, d):
    return tf_results(spark, d)


@query("k7_hybrid_search", with_(KW_SQL + TF_SQL, f"""SELECT query_id, doc_id, chunk_start, {r6('h')} AS hybrid_score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY h DESC, doc_id, chunk_start) AS INTEGER) AS rank FROM (
    SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.chunk_start, b.chunk_start) AS chunk_start,
           coalesce(a.score * 0.7, 0.0) + CASE WHEN b.query_id IS NULL THEN 0.0 ELSE 1 - 0.7 END AS h
    FROM kw a FULL OUTER JOIN tft b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.chunk_start = b.chunk_start))
WHERE rank <= 5"""))
def k7_hybrid_search(spark, d):
    return round_doubles(K.hybrid_search(kw_results(spark, d), tf_results(spark, d), k=5, doc_keys=["doc_id", "chunk_start"]))


CENT_SQL = ["""cent AS (SELECT label AS query_id, list(m ORDER BY i) AS qvec FROM (
   SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)""",
            """vd AS (SELECT query_id, vec_id,
   1 - list_sum(list_transform(list_zip(qvec, embedding), lambda x: x[1] * CAST(x[2] AS DOUBLE)))
     / (sqrt(list_sum(list_transform(qvec, lambda v: v * v))) * sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))))) AS distance
   FROM cent, embeddings)"""]


@query("k6_vector_search", with_(CENT_SQL, f"""SELECT query_id, vec_id, {r6('distance')} AS distance, rank, distance <= 1 - 0.7 AS relevant,
  round((1 - distance) * 100, 1) AS relevance FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM vd) WHERE rank <= 5"""))
def k6_vector_search(spark, d):
    emb = load_table(spark, d, "embeddings")
    return round_doubles(K.vector_search(K.label_centroids(emb), emb, k=5, threshold=0.7), 6, {"relevance": 1})


@query("k8_infer_category", """SELECT doc_id, CASE WHEN contains(lower(text), 'experiment') OR contains(lower(text), 'metrics') THEN 'Experiment'
  WHEN suffix(lower(source), '.py') OR contains(lower(text), 'code') THEN 'Code'
  WHEN contains(lower(source), 'guide') OR contains(lower(source), 'docs') OR contains(lower(text), 'api') THEN 'Documentation'
  ELSE 'General' END AS category FROM documents""")
def k8_infer_category(spark, d):
    doc = load_table(spark, d, "documents")
    return doc.select("doc_id", K.infer_category(F.col("source"), F.col("text")).alias("category"))


def _qcat_sql() -> str:
    parts = []
    for cat, words in K.QUERY_CATEGORY_WORDS:
        cond = " OR ".join(f"contains(lower(text), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{cat}'")
    return "SELECT item_id AS query_id, CASE " + " ".join(parts) + " ELSE 'General' END AS category FROM benchmark"


@query("k8_query_category", _qcat_sql())
def k8_query_category(spark, d):
    return queries_df(spark, d).select("query_id", K.query_category(F.col("query")).alias("category"))


@query("k9_context_snippets", with_(KW_SQL, """SELECT query_id, string_agg('[' || coalesce(source, 'unknown') || '] ' || trim(substring(chunk, 1, 280)), chr(10) || chr(10) ORDER BY rank) AS context
FROM kw JOIN chunks USING (doc_id, chunk_start) WHERE rank <= 3 GROUP BY query_id"""))
def k9_context_snippets(spark, d):
    return K.context_snippets(kw_results(spark, d), chunks_df(spark, d))


@query("k11_conversation_window", """SELECT conv_id, turn, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5""")
def k11_conversation_window(spark, d):
    return K.conversation_window(load_table(spark, d, "conversations"), 5)


@query("k11_session_stats", "SELECT conv_id, count(*) AS n_messages, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def k11_session_stats(spark, d):
    return K.session_stats(load_table(spark, d, "conversations"))


@query("k12_pii_scan", "SELECT doc_id, " + ", ".join(
    f"CAST(len(regexp_extract_all(text, '{p}')) AS INTEGER) AS n_{name}" for name, p in K.PII_PATTERNS.items()) + " FROM documents")
def k12_pii_scan(spark, d):
    return K.pii_scan(load_table(spark, d, "documents").select("doc_id", "text"))


@query("b8_screen_text", "SELECT conv_id, turn, CAST(length(c) AS INTEGER) AS clean_length, regexp_matches(lower(c), '" +
       "|".join(f"({p})" for p in K.INJECTION_PATTERNS) + "') AS injection, length(c) >= 1 AND length(c) <= 4000 AS valid_length "
       "FROM (SELECT conv_id, turn, trim(replace(text, chr(0), '')) AS c FROM conversations)")
def b8_screen_text(spark, d):
    s = K.screen_text(load_table(spark, d, "conversations"))
    return s.select("conv_id", "turn", F.length("clean_text").alias("clean_length"), "injection", "valid_length")
