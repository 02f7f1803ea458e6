"""Summary reports and session queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import text as T


def overview(docs: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: files, words, chunks, different tags, and the index's health: "stale" if it has no chunk."""
    tags = docs.select(F.explode("tags").alias("t")).agg(F.countDistinct("t").alias("tags"))
    sizes = documents.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))
    return sizes.crossJoin(tags).withColumn("health", F.when(F.col("chunks") > 0, "ok").otherwise("stale"))


def category_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.split("path", "/")[0].alias("category")).agg(F.count(F.lit(1)).alias("files"))


def activity(docs: DataFrame, most: int = 20) -> DataFrame:
    return docs.select("path", "updated", "access_count", "confidence").orderBy(F.desc("updated"), F.desc("access_count"), "path").limit(most)


def tag_counts(docs: DataFrame, most: int = 50) -> DataFrame:
    return docs.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "tag").limit(most)


def file_listing(docs: DataFrame, documents: DataFrame) -> DataFrame:
    return docs.select("path", "tags", "confidence", "updated").join(documents.select("path", "word_count", "chunk_count"), "path").orderBy("path")


def latest_file(docs: DataFrame, folder: str) -> DataFrame:
    """The last path of a folder, as dated files sort."""
    return docs.filter(F.col("path").startswith(folder + "/")).groupBy().agg(F.max("path").alias("path"))


def task_summary(docs: DataFrame) -> DataFrame:
    """(path, done, total) of files with tasks."""
    x = docs.select("path", T.parse_tasks(F.col("content")).alias("t")).filter(F.size("t") > 0)
    return x.select("path", F.size(F.filter("t", lambda i: i["done"])).cast("long").alias("done"), F.size("t").cast("long").alias("total"))


def flat_messages(sessions: DataFrame) -> DataFrame:
    """(id, position, role, content) of messages that aren't empty, in order."""
    x = sessions.select("id", F.posexplode("messages").alias("position", "m"))
    return x.select("id", "position", "m.role", "m.content").filter(F.coalesce("content", F.lit("")) != "")


def last_messages(messages: DataFrame, n: int, key: str = "id", order: str = "position") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def recent_sessions(sessions: DataFrame, modified: Column, cutoff: Column) -> DataFrame:
    return sessions.filter(modified >= cutoff).orderBy("id")


def last_exchange(sessions: DataFrame, most: int = 200) -> DataFrame:
    """(id, question, answer) of the session with the last name: its last user and assistant messages, cut."""
    last = sessions.groupBy().agg(F.max_by(F.struct("id", "messages"), "id").alias("s")).select("s.*")
    of = lambda role: T.snippet(F.coalesce(F.element_at(F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: m["content"]), -1), F.lit("")), most)
    return last.filter(F.size("messages") > 0).select("id", of("user").alias("question"), of("assistant").alias("answer"))


def import_counts(conversations: DataFrame, done: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row: processed, unchanged, empty and failed conversations (id, messages) against a manifest (id, hash) and the ids that failed."""
    x = conversations.select("id", F.size("messages").alias("n"), T.conversation_hash(F.col("messages")).alias("now")).join(done, "id", "left")
    bad = F.lit(False)
    if failed is not None:
        x, bad = x.join(failed.select("id", F.lit(True).alias("bad")).distinct(), "id", "left"), F.coalesce("bad", F.lit(False))
    empty, same = F.col("n") <= 0, F.col("hash").eqNullSafe(F.col("now"))
    new = ~empty & ~same
    return x.agg(F.count_if(new & ~bad).alias("processed"), F.count_if(~empty & same).alias("unchanged"), F.count_if(empty).alias("empty"), F.count_if(new & bad).alias("failed"))


def low_confidence(plan: DataFrame, least: float = 0.4) -> DataFrame:
    """A migration plan with a flag on the actions that are to be looked at."""
    return plan.withColumn("low_confidence", F.col("confidence") < least)


def read_file(docs: DataFrame, path: str) -> DataFrame:
    """(path, tags, confidence, content) of one file, without the white space around its text."""
    return docs.filter(F.col("path") == path).select("path", "tags", "confidence", F.regexp_replace("content", r"^\s+|\s+$", "").alias("content"))


def sync_status(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(path, status): local_only, remote_only, modified or same, of two manifests (path, hash)."""
    x = local.select("path", F.col("hash").alias("a")).join(remote.select("path", F.col("hash").alias("b")), "path", "full_outer")
    return x.select("path", F.when(F.col("b").isNull(), "local_only").when(F.col("a").isNull(), "remote_only").when(F.col("a") != F.col("b"), "modified").otherwise("same").alias("status"))
