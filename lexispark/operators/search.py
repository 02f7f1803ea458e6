"""Ranking: field-boosted BM25 on chunks, feedback, fusion, relevance, retrieval."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark import schema as S
from lexispark.functions import text as T

from lexispark.runtime import ranked

from .index import Index, tag_index, term_documents


def boost(field: Column) -> Column:
    return F.when(field == "tag", S.BOOST["tag"]).when(field == "path", S.BOOST["path"]).otherwise(S.BOOST["content"])


def idf(n_docs: Column, n: Column) -> Column:
    return F.log((n_docs - n + 0.5) / (n + 0.5) + 1.0)


def saturation(tf: Column, length: Column, average: Column) -> Column:
    return tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * length / average))


def _terms(index: Index, terms: list[str]) -> DataFrame:
    """(term, m): distinct query terms and how often the query has them; a query is a line of text, so it may be broadcast."""
    rows = sorted(Counter(terms).items()) or [("", 0)]
    return F.broadcast(index.docs.sparkSession.createDataFrame(rows, "term string, m int"))


def bm25_chunks(index: Index, terms: list[str]) -> DataFrame:
    """(path, chunk_id, score) of every chunk that a term reaches.

    Only the postings of the terms are built or read. A tag or path posting
    counts, divided, in each chunk of its document. Repeated terms count each time.
    """
    hits = index.postings_of(terms).join(_terms(index, terms), "term")
    df = term_documents(hits)
    stats = F.broadcast(index.stats.select("n_docs", F.coalesce(F.when(F.col("avg_chunk") > 0, F.col("avg_chunk")), F.when(F.col("avg_doc") > 0, F.col("avg_doc")), F.lit(1.0)).alias("average")))
    known = hits.join(F.broadcast(df), "term").crossJoin(stats).withColumn("idf", idf(F.col("n_docs"), F.col("n")))
    weight = lambda length: F.col("m") * F.col("idf") * saturation(F.col("frequency"), length, F.col("average")) * boost(F.col("field"))
    content = known.filter("field = 'content'").join(index.chunks.select("path", "chunk_id", "word_count"), ["path", "chunk_id"]).select("path", "chunk_id", weight(F.col("word_count")).alias("s"))
    whole = known.filter("field <> 'content'").drop("chunk_id").join(index.documents.select("path", "word_count", "chunk_count"), "path")
    spread = whole.select("path", F.explode(F.sequence(F.lit(0), F.col("chunk_count").cast("int") - 1)).alias("chunk_id"), (weight(F.col("word_count")) / F.col("chunk_count")).alias("s"))
    return content.unionByName(spread).groupBy("path", "chunk_id").agg(F.sum("s").alias("score"))


def bm25_docs(index: Index, terms: list[str]) -> DataFrame:
    """(path, score): a document's best chunk."""
    return bm25_chunks(index, terms).groupBy("path").agg(F.max("score").alias("score"))


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """By score rounded to 6 digits, then by keys: an order that doesn't hang on how sums were added up."""
    return df.orderBy(F.desc(F.round("score", 6)), *keys)


def feedback_terms(index: Index, terms: list[str]) -> tuple[list[str], DataFrame]:
    """Terms that pseudo-relevance feedback adds, and the first pass. None if nothing scores at least 1."""
    first = bm25_chunks(index, terms)
    top = ordered(first, "path", "chunk_id").limit(S.FEEDBACK_CHUNKS).collect()
    if not top or top[0]["score"] < S.FEEDBACK_LEAST:
        return [], first
    spark = index.docs.sparkSession
    keys = F.broadcast(spark.createDataFrame([(r["path"], r["chunk_id"]) for r in top], "path string, chunk_id int"))
    new = index.texts(keys).select(F.explode("tokens").alias("term")).select(T.stem(F.col("term")).alias("term")).filter(~F.col("term").isin(terms)).distinct()
    df = term_documents(index.postings_of([r["term"] for r in new.collect()]))  # the words of three chunks
    best = df.crossJoin(F.broadcast(index.stats.select("n_docs"))).select("term", F.round(idf(F.col("n_docs"), F.col("n")), 6).alias("idf")).orderBy(F.desc("idf"), "term").limit(S.FEEDBACK_TERMS)
    return [r["term"] for r in best.collect()], first


def feedback_search(index: Index, terms: list[str]) -> DataFrame:
    """Two passes: the query, then the query with the terms of its best chunks."""
    more, first = feedback_terms(index, terms)
    return bm25_chunks(index, [*terms, *more]) if more else first


def tag_query(docs: DataFrame, words: list[str]) -> DataFrame:
    """(path, score): how many of the words are tags of the path; a word given twice counts twice."""
    rows = [(w, n) for w, n in sorted(Counter(words).items())] or [("", 0)]
    given = F.broadcast(docs.sparkSession.createDataFrame(rows, "tag string, m int"))
    return tag_index(docs).join(given, "tag").groupBy("path").agg(F.sum("m").alias("score"))


def fuse(*lists: DataFrame, keys: list[str], k: int = S.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of lists of (keys, score): sum of 1 / (k + rank), ranks by range partitions."""
    places = [ranked(x.select(*keys, (-F.round("score", 6)).alias("__order")), "__order", *keys).select(*keys, (1.0 / (k + 1 + F.col("rank"))).alias("part")) for x in lists]
    out = places[0]
    for x in places[1:]:
        out = out.unionByName(x)
    return out.groupBy(*keys).agg(F.sum("part").alias("score"))


def hybrid_search(index: Index, terms: list[str], vector_hits: DataFrame | None) -> DataFrame:
    """Fusion of feedback search and vector hits (path, chunk_id, score); either alone if the other has none."""
    lexical = feedback_search(index, terms)
    if vector_hits is None or vector_hits.isEmpty():
        return lexical
    return fuse(lexical, vector_hits.filter("score > 0"), keys=["path", "chunk_id"]).join(index.chunks.select("path", "chunk_id"), ["path", "chunk_id"])


def relevance(base: Column, updated: Column, access_count: Column, confidence: Column, as_of: Column) -> Column:
    """A base score by recency (e-fold in 90 days), use and confidence."""
    days = F.greatest(F.datediff(as_of, updated), F.lit(0))
    trust = F.when(confidence == "high", 0.3).when(confidence == "medium", 0.2).otherwise(0.1)
    recent = F.coalesce(F.exp(-days / 90.0), F.lit(0.0))
    return base * (1.0 + recent + F.log(1.0 + F.coalesce(access_count, F.lit(0))) / 10.0 + trust)


def rescored(hits: DataFrame, docs: DataFrame, as_of: Column) -> DataFrame:
    x = hits.join(docs.select("path", "updated", "access_count", "confidence"), "path")
    return x.withColumn("score", relevance(F.col("score"), F.col("updated"), F.col("access_count"), F.col("confidence"), as_of)).drop("updated", "access_count", "confidence")


def per_path(hits: DataFrame, most: int) -> DataFrame:
    """At most so many chunks of a path, the best first."""
    w = Window.partitionBy("path").orderBy(F.desc(F.round("score", 6)), "chunk_id")
    return hits.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def retrieve(index: Index, query: str, as_of: Column, limit: int = S.CONTEXT_FILES, vector_hits: DataFrame | None = None) -> DataFrame:
    """(path, score, text): context for an answer. The profile comes first, where there is one; without any hit, tags decide."""
    limit = min(limit, S.CONTEXT_FILES)
    others = F.col("path") != S.PROFILE
    hits = hybrid_search(index, T.query_terms(query), vector_hits).filter(others)
    profile = index.docs.filter(~others).select("path", F.lit(None).cast("double").alias("score"), F.col("content").alias("text"))
    room = limit - profile.limit(1).count()
    if hits.isEmpty():
        tags = tag_query(index.docs, T.query_keywords(query)).filter(others)
        found = rescored(tags, index.docs, as_of).join(index.docs.select("path", F.col("content").alias("text")), "path")
        return profile.unionByName(ordered(found, "path").limit(room).select("path", "score", "text"))
    kept = rescored(per_path(hits, S.CHUNKS_PER_FILE), index.docs, as_of)
    chunks = index.chunks if "text" in index.chunks.columns else index.texts(kept.select("path", "chunk_id"))
    best = kept.join(chunks.select("path", "chunk_id", "text"), ["path", "chunk_id"])
    shown = F.when(F.col("chunk_id") > 0, F.concat("path", F.lit("#"), F.col("chunk_id").cast("string"))).otherwise(F.col("path"))
    return profile.unionByName(ordered(best, "path", "chunk_id").limit(room).select(shown.alias("path"), "score", "text"))


def tool_search(index: Index, query: str, as_of: Column) -> DataFrame:
    """(path, score, preview) of all hits: by BM25, and by tags where that finds none; scores count recency, use and trust, the preview is the first line."""
    hits = bm25_docs(index, T.query_terms(query))
    if hits.isEmpty():
        hits = tag_query(index.docs, query.lower().split())
    found = rescored(hits, index.docs, as_of).join(index.docs.select("path", T.first_line(F.col("content")).alias("preview")), "path")
    return found.select("path", "score", "preview")


def answer_confidence(n_files: Column) -> Column:
    return F.when(n_files > 3, "high").when(n_files > 1, "medium").otherwise("low")


def touch(docs: DataFrame, paths: DataFrame, as_of: Column) -> DataFrame:
    """`docs` with the paths' access counts one up; an operation of its own, since queries here change nothing."""
    used = F.col("__used").isNotNull()
    x = docs.join(paths.select("path", F.lit(1).alias("__used")).distinct(), "path", "left")
    return x.select(*(F.when(used, F.coalesce("access_count", F.lit(0)) + 1).otherwise(F.col(c)).alias(c) if c == "access_count" else F.when(used, as_of).otherwise(F.col(c)).alias(c) if c == "last_accessed" else F.col(c) for c in docs.columns))
