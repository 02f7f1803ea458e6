"""Queries on latent-semantic vectors, axes, links and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import index as I
from lexispark.operators import vectors as V
from lexispark.runtime import checkpointed, drop_shuffles, read_table, scratch

from .catalog import register
from .corpus import knowledge_files, with_sql
from .search_queries import TERMS

#: Least cosine of links here; the embeddings are nearly orthogonal.
LEAST = 0.3
#: Milliseconds of quiet between bursts of events.
APART = 6 * 3_600_000


@register("lsi_terms")
def lsi_terms(spark, sf_dir):
    x = V.lsi_terms(I.build_index(knowledge_files(spark, sf_dir)))
    return x.select("term", F.round("idf", 6).alias("idf"), F.size("vec").alias("dims"))


@register("lsi_search")
def lsi_search(spark, sf_dir):
    index = I.build_index(knowledge_files(spark, sf_dir))
    terms = checkpointed(V.lsi_terms(index))
    drop_shuffles(spark)
    q = V.query_vector(terms, TERMS)
    chunks = V.chunk_vectors(index, terms)
    hits = V.cosine_search(chunks, q) if q else chunks.withColumn("score", F.lit(0.0)).limit(0)
    return hits.select("path", "chunk_id", F.round("score", 4).alias("score"))


@register("pca3d")
def pca3d(spark, sf_dir):
    return V.principal_axes(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@register("vec_links")
def vec_links(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return V.link_graph(e, V.principal_axes(e, "vec_id", "embedding"), "vec_id", "embedding", least=LEAST)


@register("stream_dedup", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_dedup(spark, sf_dir):
    """The events as a stream, without duplicates, counted in a table that the stream writes."""
    from lexispark.streaming.corpus import without_duplicates

    path = f"{sf_dir}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    out = scratch(spark, "stream")
    q = without_duplicates(source, "event_id", "ts").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("reindex_debounced", f"""
WITH e AS (SELECT user_id::VARCHAR AS path, epoch_us(ts) // 1000 AS ms FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ms) AS k FROM (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY path ORDER BY ms) < {APART} THEN 0 ELSE 1 END AS new FROM e))
SELECT path, min(ms) AS first, max(ms) AS last, count(*) AS signals FROM g GROUP BY path, k HAVING max(ms) + {APART} <= (SELECT max(ms) FROM e)""")
def reindex_debounced(spark, sf_dir):
    """Bursts of each user's events with six hours of quiet after them, by a stream with timers."""
    from lexispark.streaming.debounce import debounced, started

    path, out = f"{sf_dir}/events.parquet", scratch(spark, "bursts")
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    bursts = debounced(source.select(F.col("user_id").cast("string").alias("path"), "ts"), ts="ts", quiet=APART)
    started(bursts, f"{out}/state", table=f"{out}/rows").awaitTermination()
    return spark.read.schema(bursts.schema).parquet(f"{out}/rows").select("path", F.unix_millis("first").alias("first"), F.unix_millis("last").alias("last"), "signals")


@register("stream_learn", with_sql("docs", r"SELECT path, array_to_string(tags, ',') || ',new' AS tags, strlen(regexp_replace(content, '\n+$', '')) + strlen('  A new line ') AS bytes FROM docs"))
def stream_learn(spark, sf_dir):
    """A corpus of all files, then a learning for each by stream; the corpus as it is after them."""
    from lexispark.streaming.corpus import Corpus, learn_stream

    root = scratch(spark, "corpus")
    docs = knowledge_files(spark, sf_dir)
    corpus = Corpus(spark, f"{root}/versions")
    corpus.publish(docs)
    news = learnings_of(docs)
    news.write.parquet(f"{root}/news")
    stream = spark.readStream.schema(news.schema).parquet(f"{root}/news")
    learn_stream(stream, corpus, "2026-01-01", f"{root}/state").awaitTermination()
    return corpus.current().docs.select("path", F.array_join("tags", ",").alias("tags"), F.octet_length("content").alias("bytes"))


def learnings_of(docs):
    """A learning for each file, which adds a line to it."""
    n = F.regexp_extract("path", r"doc-(\d+)\.md", 1).cast("long")
    topic = F.regexp_replace(F.expr("substring(path, instr(path, '/') + 1)"), r"\.md$", "")
    return docs.select(n.alias("seq"), F.split("path", "/")[0].alias("category"), topic.alias("topic"), F.array(F.lit("new")).alias("tags"), F.lit("A new line").alias("content"), F.lit("low").alias("confidence"), F.lit("append").alias("action"))
