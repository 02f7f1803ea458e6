"""The inverted index as tables, built whole or from what has changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.runtime import checkpointed, drop_shuffles

POSTING = ["term", "path", "field", "chunk_id", "frequency"]


@dataclass
class Index:
    """docs as given; chunks(path, chunk_id, text, tokens, word_count), saved without text and tokens; documents(path, word_count, chunk_count, ...);
    postings(term, path, field, chunk_id, frequency); stats, one row of n_docs, n_chunks, avg_doc, avg_chunk."""

    docs: DataFrame
    chunks: DataFrame
    documents: DataFrame
    postings: DataFrame
    stats: DataFrame
    saved: bool = False

    def save(self, path: str) -> None:
        """Parquet tables under one folder but for the docs; postings are sorted by term so that row groups can be skipped."""
        for name in ("chunks", "documents", "stats"):
            written(getattr(self, name).drop("text", "tokens"), f"{path}/{name}")
        written(self.postings.repartitionByRange("term").sortWithinPartitions("term", "path"), f"{path}/postings")

    @staticmethod
    def load(spark, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("docs", "chunks", "documents", "postings", "stats")), saved=True)

    def texts(self, keys: DataFrame) -> DataFrame:
        """The chunks with their text and tokens of the paths and numbers in `keys`; cut anew from the docs of those paths where they aren't kept."""
        chunks = self.chunks
        if "tokens" not in chunks.columns:
            chunks = chunk_table(self.docs.join(keys.select("path").distinct(), "path", "left_semi"))
        return chunks.join(keys, ["path", "chunk_id"])

    def postings_of(self, terms: list[str]) -> DataFrame:
        """The postings of some terms: read by row group if saved, else built from the tokens that have one of the terms as stem."""
        wanted = F.col("term").isin(sorted(set(terms)) or [""])
        if self.saved:
            return self.postings.filter(wanted)
        forms = self.docs.sparkSession.createDataFrame([(t,) for t in T.surface_forms(sorted(set(terms))) or [""]], "word string")
        some = _stemmed(self.chunks.select("path", "chunk_id", F.explode("tokens").alias("word")).join(F.broadcast(forms), "word"))
        whole = tag_postings(self.docs).unionByName(path_postings(self.docs))
        return some.filter(wanted).unionByName(whole.filter(wanted))


def by_path(docs: DataFrame) -> DataFrame:
    """`docs` dealt by path, so that what is counted of a path or its chunks needs no shuffle of words; texts are a fraction of them."""
    return docs.repartition("path")


def chunk_table(docs: DataFrame) -> DataFrame:
    """(path, chunk_id, text, tokens, word_count): word_count counts tokens, not words."""
    cut = docs.select("path", F.posexplode(T.chunks(F.col("content"))).alias("chunk_id", "text"))
    return cut.withColumn("tokens", T.tokens(F.col("text"))).withColumn("word_count", F.size("tokens"))


def _stemmed(words: DataFrame) -> DataFrame:
    """Content postings of (path, chunk_id, word)."""
    terms = words.select("path", "chunk_id", T.stem(F.col("word")).alias("term"))  # outside of arrays, so in generated code
    return terms.groupBy("term", "path", "chunk_id").agg(F.count(F.lit(1)).alias("frequency")).select("term", "path", F.lit("content").alias("field"), "chunk_id", "frequency")


def content_postings(chunks: DataFrame) -> DataFrame:
    return _stemmed(chunks.select("path", "chunk_id", F.explode("tokens").alias("word")))


def _document_postings(docs: DataFrame, words, field: str) -> DataFrame:
    terms = docs.select("path", F.explode(words).alias("term"))
    return terms.groupBy("term", "path").agg(F.count(F.lit(1)).alias("frequency")).select("term", "path", F.lit(field).alias("field"), F.lit(None).cast("int").alias("chunk_id"), "frequency")


def tag_postings(docs: DataFrame) -> DataFrame:
    return _document_postings(docs, F.flatten(F.transform("tags", T.stems)), "tag")


def path_postings(docs: DataFrame) -> DataFrame:
    parts = F.split(F.regexp_replace("path", r"\.md$", ""), "/")
    return _document_postings(docs, F.flatten(F.transform(parts, T.stems)), "path")


def document_table(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    sizes = chunks.groupBy("path").agg(F.sum("word_count").alias("word_count"), F.count(F.lit(1)).alias("chunk_count"))
    return docs.select("path", "tags", "updated", "access_count", "confidence").join(sizes, "path")


def stats_table(documents: DataFrame) -> DataFrame:
    """Averages from the documents alone: their words are their chunks' words."""
    words, chunks = F.sum("word_count"), F.sum("chunk_count")
    return documents.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(chunks, F.lit(0)).alias("n_chunks"), F.avg("word_count").alias("avg_doc"), (words / chunks).alias("avg_chunk"))


def build_index(docs: DataFrame, keep: bool = False) -> Index:
    """All tables from `docs`; `keep` writes the chunks with their tokens once, for the other tables and later queries."""
    chunks = chunk_table(by_path(docs))
    chunks = checkpointed(chunks) if keep else chunks
    documents = document_table(docs, chunks)
    postings = content_postings(chunks).unionByName(tag_postings(docs)).unionByName(path_postings(docs))
    return Index(docs, chunks, documents, postings, stats_table(documents))


def written(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_postings(docs: DataFrame, path: str) -> DataFrame:
    """Write the postings of `docs` as a table; (path, chunk_id, word_count) of their chunks, which lies in `{path}.cut` until that is removed.

    Texts are dealt by path, cut and tokenised once; no token is kept and no posting shuffled, as a chunk gives its terms and one row of no term with
    its words. A file holds the postings of some paths by term, so that row groups and pages can be skipped.
    """
    spark = docs.sparkSession
    end = F.array(F.lit(None).cast("string"))
    words = chunk_table(by_path(docs.select("path", "content"))).select("path", "chunk_id", "word_count", F.explode(F.concat("tokens", end)).alias("word"))
    terms = words.select("path", "chunk_id", "word_count", T.stem(F.col("word")).alias("term")).groupBy("term", "path", "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.first("word_count").alias("words"))
    ends = F.col("term").isNull()
    rows = terms.select(ends.cast("int").alias("end"), "term", "path", F.lit("content").alias("field"), "chunk_id", F.when(ends, F.col("words")).otherwise(F.col("n")).alias("frequency"))
    rows.sortWithinPartitions("end", "term", "path", "chunk_id").write.mode("overwrite").option("compression", "zstd").partitionBy("end").parquet(f"{path}.cut")
    _moved(spark, f"{path}.cut/end=0", path)
    written(tag_postings(docs).unionByName(path_postings(docs)).sortWithinPartitions("term", "path"), path, "append")
    drop_shuffles(spark)
    kind = "path string, chunk_id int, frequency long"
    at, fs = _file(spark, f"{path}.cut/end=1")
    chunks = spark.read.schema(kind).parquet(f"{path}.cut/end=1") if fs.exists(at) else spark.createDataFrame([], kind)
    return chunks.select("path", "chunk_id", F.col("frequency").cast("int").alias("word_count"))


def write_index(docs: DataFrame, path: str) -> None:
    """The tables of `Index.save` of `docs`, which lie in `{path}/docs`, from one pass over the texts."""
    spark = docs.sparkSession
    written(write_postings(docs, f"{path}/postings"), f"{path}/chunks")
    removed(spark, f"{path}/postings.cut")
    written(document_table(docs, spark.read.parquet(f"{path}/chunks")), f"{path}/documents")
    written(stats_table(spark.read.parquet(f"{path}/documents")), f"{path}/stats")


def _file(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _moved(spark, source: str, target: str) -> None:
    """A folder, if it is there, in place of another one."""
    removed(spark, target)
    (a, fs), (b, _) = _file(spark, source), _file(spark, target)
    if fs.exists(a) and not fs.rename(a, b):
        raise OSError(f"{source} could not be moved to {target}")


def removed(spark, path: str) -> None:
    at, fs = _file(spark, path)
    fs.delete(at, True)


def tag_index(docs: DataFrame) -> DataFrame:
    """(tag, path): tags as they are, each once for a path."""
    return docs.select(F.explode("tags").alias("tag"), "path").distinct()


def document_terms(docs: DataFrame) -> DataFrame:
    """(term, path, frequency) of contents, without chunks: their cuts fall between words, so words are the text's own."""
    words = by_path(docs.select("path", "content")).select("path", F.explode(T.tokens(F.col("content"))).alias("word"))
    return words.select("path", T.stem(F.col("word")).alias("term")).groupBy("term", "path").agg(F.count(F.lit(1)).alias("frequency"))


def term_documents(postings: DataFrame) -> DataFrame:
    """(term, n): documents that have a term, counted in two steps so that both combine before their shuffle."""
    return postings.groupBy("term", "path").agg(F.lit(1).alias("one")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def embedding_texts(docs: DataFrame, chunks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(path, chunk_id, text) with the document's tags in front, as an embedder gets it; `only`: paths to do."""
    prefix = F.when(F.size("tags") > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", "), F.lit(". "))).otherwise("")
    out = chunks.join(docs.select("path", "tags"), "path").select("path", "chunk_id", F.concat(prefix, "text").alias("text"))
    return out.join(only.select("path"), "path", "left_semi") if only is not None else out


# ---- incremental maintenance ----


def file_hashes(docs: DataFrame) -> DataFrame:
    """(path, hash): the hash covers what is indexed and no access counts, so reading changes nothing."""
    whole = F.concat_ws("\x1f", "path", F.array_join("tags", "\x1e"), "content")
    return docs.select("path", T.content_hash(whole).alias("hash"))


def manifest(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, hash, chunks) of files."""
    return file_hashes(docs).join(chunks.groupBy("path").agg(F.count(F.lit(1)).alias("chunks")), "path", "left").fillna(0, ["chunks"])


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state): unchanged, dirty (new or changed) or deleted."""
    o, n = old.select("path", F.col("hash").alias("was")), new.select("path", F.col("hash").alias("now"))
    state = F.when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("dirty")
    return o.join(n, "path", "full_outer").select("path", state.alias("state"))


def rebuild_is_cheaper(dirty: int, deleted: int, files: int, had_manifest: bool) -> bool:
    """Whole rebuild without a manifest, or if over half (rounded down) of the files changed."""
    return not had_manifest or dirty + deleted > files // 2


def delta_index(base: Index, docs: DataFrame, diff: DataFrame, keep: bool = False) -> Index:
    """The index of `docs` from that of an earlier version: what changed goes, what is dirty comes anew; `keep` as in `build_index`."""
    gone = diff.filter("state <> 'unchanged'").select("path")
    dirty = docs.join(diff.filter("state = 'dirty'").select("path"), "path", "left_semi")
    fresh = build_index(dirty, keep)
    both = lambda name: getattr(base, name).join(gone, "path", "left_anti").unionByName(getattr(fresh, name).select(getattr(base, name).columns))
    documents = both("documents")
    return Index(docs, both("chunks"), documents, both("postings"), stats_table(documents))


def merge_vectors(base: DataFrame, removed: DataFrame, delta: DataFrame) -> DataFrame:
    """Chunk vectors without those of removed paths; those of `delta` win."""
    kept = base.join(removed.select("path"), "path", "left_anti").join(delta.select("path", "chunk_id"), ["path", "chunk_id"], "left_anti")
    return kept.unionByName(delta)


def reusable_vectors(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(path, chunk_id, text, hash, vec): vec is null where no earlier vector has the text's hash."""
    known = vectors.groupBy("content_hash").agg(F.min_by("vec", F.struct("path", "chunk_id")).alias("vec"))
    return texts.withColumn("hash", T.content_hash(F.col("text"))).join(known, F.col("hash") == known.content_hash, "left").drop("content_hash")
