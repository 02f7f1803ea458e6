"""Queries on tokens, the index, and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark import schema as S
from lexispark.functions import text as T
from lexispark.operators import index as I
from lexispark.operators import search as R
from lexispark.runtime import read_table

from .catalog import register
from .corpus import AS_OF, QUERY, _list, as_of, knowledge_files, sql_bm25, sql_terms, sql_tokens, with_sql

TERMS = T.query_terms(QUERY)
_ORDER = "ORDER BY round(score, 6) DESC, path, chunk_id"


def _index(spark, sf_dir) -> I.Index:
    return I.build_index(knowledge_files(spark, sf_dir), keep=True)


def _rounded(df, *keys):
    return df.select(*keys, F.round("score", 6).alias("score"))


@register("tokenize_counts", f"SELECT doc_id, len({sql_tokens('text')}) AS n_tokens, len(list_distinct({sql_tokens('text')})) AS n_distinct FROM documents")
def tokenize_counts(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@register("stem_vocabulary", with_sql("words", "SELECT term, count(*) AS n, count(DISTINCT path) AS files FROM words GROUP BY term"))
def stem_vocabulary(spark, sf_dir):
    p = I.document_terms(knowledge_files(spark, sf_dir))
    return p.groupBy("term").agg(F.sum("frequency").alias("n"), F.count(F.lit(1)).alias("files"))


@register("keyword_filter", rf"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda w: regexp_replace(w, '^[?!.,;:''"]+|[?!.,;:''"]+$', '', 'g')), lambda w: w <> '' AND NOT list_contains({_list(T.QUERY_STOP_WORDS)}, w)), ' ') AS keywords FROM conversations WHERE role = 'user'""")
def keyword_filter(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


@register("chunk_words", with_sql("chunks", "SELECT path, chunk_id, word_count::BIGINT AS word_count FROM chunks"))
def chunk_words(spark, sf_dir):
    return I.chunk_table(knowledge_files(spark, sf_dir)).select("path", "chunk_id", F.col("word_count").cast("long").alias("word_count"))


@register("chunk_stats", with_sql("docs sized", "SELECT category, count(*) AS files, sum(chunk_count)::BIGINT AS chunks, max(word_count)::BIGINT AS longest FROM docs JOIN sized USING (path) GROUP BY category"))
def chunk_stats(spark, sf_dir):
    d = knowledge_files(spark, sf_dir)
    x = I.document_table(d, I.chunk_table(d))
    return x.groupBy(F.split("path", "/")[0].alias("category")).agg(F.count(F.lit(1)).alias("files"), F.sum("chunk_count").alias("chunks"), F.max("word_count").alias("longest"))


@register("corpus_stats", with_sql("stats", "SELECT n_docs, n_chunks::BIGINT AS n_chunks, round(avg_doc, 6) AS avg_doc, round(avg_chunk, 6) AS avg_chunk FROM stats"))
def corpus_stats(spark, sf_dir):
    return _index(spark, sf_dir).stats.select("n_docs", "n_chunks", F.round("avg_doc", 6).alias("avg_doc"), F.round("avg_chunk", 6).alias("avg_chunk"))


@register("postings_content", with_sql("content_p", "SELECT term, path, chunk_id, frequency FROM content_p"))
def postings_content(spark, sf_dir):
    return I.content_postings(I.chunk_table(I.by_path(knowledge_files(spark, sf_dir)))).select("term", "path", "chunk_id", "frequency")


@register("postings_tag", with_sql("tag_p", "SELECT term, path, frequency FROM tag_p"))
def postings_tag(spark, sf_dir):
    return I.tag_postings(knowledge_files(spark, sf_dir)).select("term", "path", "frequency")


@register("postings_path", with_sql("path_p", "SELECT term, path, frequency FROM path_p"))
def postings_path(spark, sf_dir):
    return I.path_postings(knowledge_files(spark, sf_dir)).select("term", "path", "frequency")


@register("term_idf", with_sql("postings stats", "SELECT term, count(DISTINCT path) AS n, round(ln((any_value(n_docs) - count(DISTINCT path) + 0.5) / (count(DISTINCT path) + 0.5) + 1), 6) AS idf FROM postings, stats GROUP BY term"))
def term_idf(spark, sf_dir):
    d = knowledge_files(spark, sf_dir)
    terms = I.document_terms(d).unionByName(I.tag_postings(d).unionByName(I.path_postings(d)).select("term", "path", "frequency"))
    return I.term_documents(terms).crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("n_docs")))).select("term", "n", F.round(R.idf(F.col("n_docs"), F.col("n")), 6).alias("idf"))


@register("tag_index", with_sql("docs", "SELECT DISTINCT unnest(tags) AS tag, path FROM docs"))
def tag_index(spark, sf_dir):
    return I.tag_index(knowledge_files(spark, sf_dir))


@register("tag_query", with_sql("docs", "SELECT path, sum(m)::BIGINT AS score FROM (SELECT DISTINCT unnest(tags) AS tag, path FROM docs) JOIN (VALUES ('en', 2), ('src3', 1)) v(tag, m) USING (tag) GROUP BY path"))
def tag_query(spark, sf_dir):
    return R.tag_query(knowledge_files(spark, sf_dir), ["en", "src3", "en"])


_BM = sql_bm25("q", "hits")


@register("bm25_chunks", with_sql("postings chunks sized stats", "SELECT path, chunk_id, round(score, 6) AS score FROM hits", {"q": sql_terms(TERMS), **_BM}))
def bm25_chunks(spark, sf_dir):
    return _rounded(R.bm25_chunks(_index(spark, sf_dir), TERMS), "path", "chunk_id")


@register("bm25_docs", with_sql("postings chunks sized stats", f"SELECT path, round(max(score), 6) AS score FROM hits GROUP BY path", {"q": sql_terms(TERMS), **_BM}))
def bm25_docs(spark, sf_dir):
    return _rounded(R.bm25_docs(_index(spark, sf_dir), TERMS), "path")


_FIELDED = ["src3", "opinion", "en", "reer"]


@register("bm25_fielded", with_sql("postings chunks sized stats", "SELECT path, chunk_id, round(score, 6) AS score FROM hits", {"q": sql_terms(_FIELDED), **_BM}))
def bm25_fielded(spark, sf_dir):
    """Terms that are tags, parts of paths and words."""
    return _rounded(R.bm25_chunks(_index(spark, sf_dir), _FIELDED), "path", "chunk_id")


@register("bm25_repeated_term", with_sql("postings chunks sized stats", "SELECT path, chunk_id, round(score, 6) AS score FROM hits", {"q": sql_terms(["reer"] * 3 + ["onha"]), **_BM}))
def bm25_repeated_term(spark, sf_dir):
    return _rounded(R.bm25_chunks(_index(spark, sf_dir), ["reer"] * 3 + ["onha"]), "path", "chunk_id")


_PRF = {
    "q": sql_terms(TERMS), **_BM,
    "best": f"SELECT path, chunk_id, score FROM hits {_ORDER} LIMIT {S.FEEDBACK_CHUNKS}",
    "new": "SELECT DISTINCT w.term FROM words w JOIN best USING (path, chunk_id) WHERE w.term NOT IN (SELECT term FROM q) AND (SELECT max(score) FROM best) >= 1",
    "more": f"SELECT term, round(ln((any_value(n_docs) - count(DISTINCT path) + 0.5) / (count(DISTINCT path) + 0.5) + 1), 6) AS idf FROM postings JOIN new USING (term), stats GROUP BY term ORDER BY idf DESC, term LIMIT {S.FEEDBACK_TERMS}",
}
_PRF2 = {**_PRF, "q2": "SELECT term, m FROM q UNION ALL SELECT term, 1 FROM more", **sql_bm25("q2", "again")}


@register("prf_terms", with_sql("postings chunks sized stats words", "SELECT term, idf FROM more", _PRF))
def prf_terms(spark, sf_dir):
    x = _index(spark, sf_dir)
    terms, _ = R.feedback_terms(x, TERMS)
    return I.term_documents(x.postings_of(terms)).crossJoin(F.broadcast(x.stats.select("n_docs"))).select("term", F.round(R.idf(F.col("n_docs"), F.col("n")), 6).alias("idf"))


@register("prf_search", with_sql("postings chunks sized stats words", f"SELECT path, chunk_id, round(score, 6) AS score FROM again", _PRF2))
def prf_search(spark, sf_dir):
    return _rounded(R.feedback_search(_index(spark, sf_dir), TERMS), "path", "chunk_id")


_REL = f"""(1 + exp(-greatest(DATE '{AS_OF}' - updated, 0) / 90.0) + ln(1.0 + access_count) / 10 + CASE confidence WHEN 'high' THEN 0.3 WHEN 'medium' THEN 0.2 ELSE 0.1 END)"""


@register("relevance_rescore", with_sql("docs postings chunks sized stats", f"SELECT path, round(max(score) * any_value({_REL}), 5) AS score FROM hits JOIN docs USING (path) GROUP BY path", {"q": sql_terms(TERMS), **_BM}))
def relevance_rescore(spark, sf_dir):
    x = _index(spark, sf_dir)
    return R.rescored(R.bm25_docs(x, TERMS), x.docs, as_of()).select("path", F.round("score", 5).alias("score"))


def _vector_hits(spark, sf_dir):
    """Embeddings by document id against the first one, as hits on first chunks."""
    from lexispark.operators import vectors as V

    e = read_table(spark, sf_dir, "embeddings")
    q = e.orderBy("vec_id").first()["embedding"]
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    hits = V.cosine_search(e.select("vec_id", "embedding"), list(q), "embedding")
    category = F.element_at(F.array(*map(F.lit, S.CATEGORIES)), (F.col("doc_id") % 9 + 1).cast("int"))
    x = hits.join(d, F.col("vec_id") == F.col("doc_id"))
    return x.select(F.concat_ws("/", category, "source", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.lit(0).alias("chunk_id"), "score")


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@register("vec_search", f"SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b WHERE {_COS} > 0")
def vec_search(spark, sf_dir):
    from lexispark.operators import vectors as V

    e = read_table(spark, sf_dir, "embeddings")
    q = e.orderBy("vec_id").first()["embedding"]
    return V.cosine_search(e, list(q), "embedding").select("vec_id", F.round("score", 6).alias("score"))


_RRF = {
    **_PRF2,
    "vec": f"SELECT d.path, 0 AS chunk_id, {_COS} AS score FROM embeddings a JOIN docs d ON d.doc_id = a.vec_id, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b WHERE {_COS} > 0",
    "fused": f"SELECT path, chunk_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT path, chunk_id, row_number() OVER ({_ORDER}) AS r FROM again UNION ALL SELECT path, chunk_id, row_number() OVER ({_ORDER}) FROM vec) GROUP BY path, chunk_id",
}


@register("rrf_hybrid", with_sql("docs postings chunks sized stats words", f"SELECT path, chunk_id, round(score, 9) AS score FROM fused", _RRF))
def rrf_hybrid(spark, sf_dir):
    hits = R.hybrid_search(_index(spark, sf_dir), TERMS, _vector_hits(spark, sf_dir))
    return hits.select("path", "chunk_id", F.round("score", 9).alias("score"))


_TWO = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(score, 6) DESC, chunk_id) AS n FROM again) WHERE n <= 2"


@register("retrieve_topk", with_sql("docs postings chunks sized stats words", f"SELECT path || CASE WHEN chunk_id > 0 THEN '#' || chunk_id ELSE '' END AS path, round(s, 5) AS score FROM (SELECT path, chunk_id, score * {_REL} AS s FROM two JOIN docs USING (path) ORDER BY round(s, 6) DESC, path, chunk_id LIMIT 5)", {**_PRF2, "two": _TWO}))
def retrieve_topk(spark, sf_dir):
    return R.retrieve(_index(spark, sf_dir), QUERY, as_of()).select("path", F.round("score", 5).alias("score"))


@register("dashboard_search", with_sql("docs cut postings chunks sized stats words", "SELECT path, chunk_id, round(score, 6) AS score FROM (SELECT * FROM two ORDER BY round(score, 6) DESC, path, chunk_id LIMIT 20)", {**_PRF2, "two": _TWO}))
def dashboard_search(spark, sf_dir):
    hits = R.per_path(R.feedback_search(_index(spark, sf_dir), TERMS), S.CHUNKS_PER_FILE)
    return _rounded(R.ordered(hits, "path", "chunk_id").limit(20), "path", "chunk_id")


_ASK = f"SELECT path, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY path {_ORDER}) AS n FROM again) WHERE n = 1 {_ORDER} LIMIT 3"


@register("ask_context", with_sql("docs postings chunks sized stats words", "SELECT path, chunk_id, round(score, 6) AS score FROM ask", {**_PRF2, "ask": _ASK}))
def ask_context(spark, sf_dir):
    """The best chunk of each of the three best files."""
    hits = R.per_path(R.feedback_search(_index(spark, sf_dir), TERMS), 1)
    return _rounded(R.ordered(hits, "path", "chunk_id").limit(3), "path", "chunk_id")


_PREVIEW = r"split_part(regexp_replace(content, '^\s+|\s+$', '', 'g'), chr(10), 1)"


@register("tool_search", with_sql("docs postings chunks sized stats", f"SELECT path, round(max(score) * any_value({_REL}), 5) AS score, any_value({_PREVIEW}) AS preview FROM hits JOIN docs USING (path) GROUP BY path", {"q": sql_terms(TERMS), **_BM}))
def tool_search(spark, sf_dir):
    return R.tool_search(_index(spark, sf_dir), QUERY, as_of()).select("path", F.round("score", 5).alias("score"), "preview")


@register("answer_confidence", "SELECT user_id, count(*) AS n_files, CASE WHEN count(*) > 3 THEN 'high' WHEN count(*) > 1 THEN 'medium' ELSE 'low' END AS confidence FROM events GROUP BY user_id")
def answer_confidence(spark, sf_dir):
    x = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_files"))
    return x.withColumn("confidence", R.answer_confidence(F.col("n_files")))
