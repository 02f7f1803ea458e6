"""Texts for a model: the files and messages of a prompt, put together; calling a model is left to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark import schema as S

EXPERTISE_MAP = "expertise/map.md"
#: What a learning must look like, for the prompts that ask for some.
LEARNING_FORM = (
    "Answer with a JSON array of objects with the keys category (one of " + ", ".join(S.CATEGORIES) + "), topic (a slug), tags, content (markdown), confidence (high, medium, low) "
    "and action: create for a new topic, append for new facts on a known one, replace where a known one is contradicted. Answer [] if there is nothing."
)


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def entry(most: int | None = None) -> Column:
    """A file under its path, cut to `most` characters."""
    text = _bare(F.col("content"))
    cut = text if most is None else F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
    return F.concat(F.lit("### "), "path", F.lit("\n"), cut, F.lit("\n\n"))


def joined(order: Column, block: Column) -> Column:
    """Blocks of a group as one text: what a prompt holds, so few."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), block.alias("b")))), lambda x: x["b"]), "")


def system_prompt(files: DataFrame, head: str, mirror: str) -> DataFrame:
    """One row, `prompt`: the head, style files as they are under the line `mirror`, then the others under their paths."""
    style = F.col("path").startswith("style/")
    block = F.when(style, F.concat(_bare(F.col("content")), F.lit("\n\n"))).otherwise(entry())
    parts = files.agg(joined(F.struct((~style).alias("last"), "path"), block).alias("all"), F.count_if(style).alias("n"))
    return parts.select(F.concat(F.lit(head + "\n"), F.when(F.col("n") > 0, F.lit(f"## {mirror}\n\n")).otherwise(""), "all").alias("prompt"))


def conversation_prompts(messages: DataFrame, head: str, files: DataFrame | None = None, key: str = "id", order: str = "position", most: int = 300) -> DataFrame:
    """(key, prompt) for each conversation (key, order, role, content): the head, the files known already, the messages, the form of learnings.

    For learning from an exchange and for reflecting on sessions alike; they differ in their heads.
    """
    talks = messages.groupBy(key).agg(joined(F.col(order), F.concat("role", F.lit(": "), "content", F.lit("\n"))).alias("talk"))
    known = F.lit("")
    if files is not None:
        talks = talks.crossJoin(F.broadcast(files.agg(joined(F.col("path"), entry(most)).alias("known"))))  # one row
        known = F.when(F.col("known") == "", "").otherwise(F.concat(F.lit("Known already:\n"), "known"))
    return talks.select(key, F.concat(F.lit(head + "\n\n"), known, F.lit("Conversation:\n"), "talk", F.lit("\n" + LEARNING_FORM)).alias("prompt"))


def contradiction_prompts(docs: DataFrame, batches: DataFrame, head: str, most: int = 400) -> DataFrame:
    """(category, batch, prompt) for each batch (category, batch, path) of files to hold against each other."""
    x = batches.join(docs.select("path", "content"), "path")
    return x.groupBy("category", "batch").agg(joined(F.col("path"), entry(most)).alias("all")).select("category", "batch", F.concat(F.lit(head + " "), "category", F.lit("\n\n"), "all").alias("prompt"))


def expertise_files(docs: DataFrame, most: int = 60) -> DataFrame:
    """The first files by path, without the map that is made of them."""
    return docs.filter(F.col("path") != EXPERTISE_MAP).orderBy("path").limit(most)


def expertise_prompt(files: DataFrame, head: str, date: str, most: int = 300) -> DataFrame:
    """One row, `prompt`: the head, the files, the date that the map is to carry."""
    return files.agg(joined(F.col("path"), entry(most)).alias("all")).select(F.concat(F.lit(head + "\n\n"), "all", F.lit(f"Generated: {date}\n")).alias("prompt"))


def prompt_context(docs: DataFrame, most: int = 300, files: int | None = None) -> DataFrame:
    """(position, block) of a prompt: files of style/ first, then by path, each cut to `most` characters; the first `files` if given."""
    from lexispark.runtime import ranked

    x = docs.select(F.when(F.col("path").startswith("style/"), 0).otherwise(1).alias("kind"), "path", "content")
    if files is not None:
        x = x.orderBy("kind", "path").limit(files)
    cut = F.when(F.char_length("content") > most, F.concat(F.substring("content", 1, most), F.lit("..."))).otherwise(F.col("content"))
    return ranked(x, "kind", "path").select((F.col("rank") + 1).alias("position"), F.concat(F.lit("### "), "path", F.lit("\n"), cut, F.lit("\n")).alias("block"))
