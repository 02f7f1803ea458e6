"""Streams: learnings into corpus versions, and events without duplicates."""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexispark.operators import index as I
from lexispark.operators.maintenance import learn
from lexispark.runtime import checkpointed, drop_shuffles


def without_duplicates(events: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """The first event of a key within the watermark; times without zone count as UTC."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, ts: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    x = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return x.groupBy(F.window(ts, size), by).agg(F.count(F.lit(1)).alias("n"))


MANIFEST = "path string, hash string, chunks long"
VECTORS = "path string, chunk_id int, content_hash string, vec array<double>"


def read_or_empty(spark, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one where it is missing, damaged or of other columns."""
    empty = spark.createDataFrame([], schema)
    try:
        found = spark.read.parquet(path)
        if set(empty.columns) <= set(found.columns):
            found.isEmpty()  # reads a row, so that a damaged file shows
            return found.select(*(F.col(c).cast(t) for c, t in empty.dtypes))
    except (PySparkException, Py4JJavaError) as e:
        if not re.search("PATH_NOT_FOUND|UNABLE_TO_INFER_SCHEMA|FAILED_READ_FILE|is not a Parquet file", str(e)):
            raise
    return empty


def read_manifest(spark, path: str) -> DataFrame:
    return read_or_empty(spark, path, MANIFEST)


class Corpus:
    """Versions of a corpus and its index in one folder; a version is written whole before it is the current one."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root
        self._held: tuple[int, I.Index] | None = None

    def folder(self, version: int) -> str:
        return f"{self.root}/v{version:08d}"

    def versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(done(f"{self.root}/{n}/manifest/_SUCCESS")))

    def current(self) -> I.Index:
        """The newest version's index, read anew only when there is a newer one; of no version at all, an error."""
        versions = self.versions()
        if not versions:
            raise LookupError(f"{self.root} holds no version")
        if self._held is None or self._held[0] != versions[-1]:
            self._held = versions[-1], I.Index.load(self.spark, self.folder(versions[-1]))
        return self._held[1]

    def ensure(self, docs: DataFrame) -> I.Index:
        """The current index, built from `docs` first if there is none or it has no chunk."""
        if not self.versions() or self.current().chunks.isEmpty():
            self.publish(docs)
        return self.current()

    def manifest(self, version: int) -> DataFrame:
        """(path, hash, chunks) of a version; empty if it is missing or can't be read."""
        return read_manifest(self.spark, f"{self.folder(version)}/manifest")

    def save_vectors(self, vectors: DataFrame, version: int) -> None:
        """(path, chunk_id, content_hash, vec) beside a version's tables."""
        vectors.write.mode("overwrite").parquet(f"{self.folder(version)}/vectors")

    def vectors(self, version: int) -> DataFrame:
        return read_or_empty(self.spark, f"{self.folder(version)}/vectors", VECTORS)

    def update_vectors(self, embed: Callable[[DataFrame], DataFrame], version: int) -> DataFrame:
        """Vectors of a version's chunks: those that an earlier version has by text hash, and `embed` of the others."""
        index = I.Index.load(self.spark, self.folder(version))
        earlier = [v for v in self.versions() if v < version]
        known = self.vectors(earlier[-1]) if earlier else self.spark.createDataFrame([], VECTORS)
        texts = checkpointed(I.reusable_vectors(I.embedding_texts(index.docs, I.chunk_table(index.docs)), known))
        old = texts.filter("vec IS NOT NULL").select("path", "chunk_id", F.col("hash").alias("content_hash"), "vec")
        new = embed(texts.filter("vec IS NULL").select("path", "chunk_id", "text"))
        self.save_vectors(old.unionByName(new.filter("vec IS NOT NULL").select("path", "chunk_id", "content_hash", "vec")), version)
        return self.vectors(version)

    def publish(self, docs: DataFrame, version: int | None = None) -> dict:
        """Index `docs`, by what changed where that is less; the manifest comes last and makes the version count."""
        old = self.versions()
        version = (old[-1] + 1 if old else 1) if version is None else version
        if version in old:
            return {"version": version, "skipped": True}
        folder, kind = self.folder(version), docs.schema
        I.written(docs, f"{folder}/docs")  # what they come from runs once, not for each table
        drop_shuffles(self.spark)
        docs = self.spark.read.schema(kind).parquet(f"{folder}/docs")
        if old:
            diff = checkpointed(I.manifest_diff(self.manifest(old[-1]), I.file_hashes(docs)))
            n = {r["state"]: r["count"] for r in diff.groupBy("state").count().collect()}
        else:
            diff, n = None, {}
        whole = I.rebuild_is_cheaper(n.get("dirty", 0), n.get("deleted", 0), sum(n.values()) - n.get("deleted", 0), bool(old))
        if whole:
            I.write_index(docs, folder)
        else:
            I.delta_index(self.current(), docs, diff, keep=True).save(folder)
        counts = self.spark.read.parquet(f"{folder}/documents").select("path", F.col("chunk_count").alias("chunks"))
        new = I.file_hashes(docs).join(counts, "path", "left").fillna(0, ["chunks"])
        I.written(new, f"{folder}/manifest")
        drop_shuffles(self.spark)
        return {"version": version, "rebuilt": whole, **n}


def learn_stream(learnings: DataFrame, corpus: Corpus, as_of: str, checkpoint: str, then: Callable | None = None) -> StreamingQuery:
    """Each micro-batch of learnings becomes the next version; a batch that is run again is known by its number."""
    base = max(corpus.versions(), default=0)

    def apply(batch: DataFrame, number: int) -> None:
        version = base + 1 + number
        if version not in corpus.versions():
            corpus.publish(learn(corpus.current().docs, batch, as_of), version)
        if then:
            then(version)

    return learnings.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
