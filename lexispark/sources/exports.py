"""Conversation exports, sessions, and connectors for pull requests and sheets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark import schema as S

from .connect import register_sources

FLAT = "array<struct<uuid:string,name:string,chat_messages:array<struct<uuid:string,sender:string,text:string>>>>"
TREE = "array<struct<id:string,title:string,mapping:map<string,struct<id:string,message:struct<author:struct<role:string>,content:struct<content_type:string,parts:string>>,parent:string,children:array<string>>>>>"


def flat_export(raw: DataFrame) -> DataFrame:
    """(id, title, messages) of exports (value: JSON text): human is user, any other sender assistant; empty texts go."""
    x = raw.select(F.explode(F.from_json("value", FLAT, {"mode": "FAILFAST"})).alias("c"))
    said = F.filter("c.chat_messages", lambda m: F.coalesce(m["text"], F.lit("")) != "")
    turn = lambda m: F.struct(F.when(m["sender"] == "human", "user").otherwise("assistant").alias("role"), m["text"].alias("content"))
    return x.select(F.col("c.uuid").alias("id"), F.col("c.name").alias("title"), F.coalesce(F.transform(said, turn), F.array().cast(S.MESSAGES)).alias("messages"))


def tree_messages(mapping: Column) -> Column:
    """Messages on the way from the root (of several, the least id) along first children; each node once.

    Parts that are strings are joined, others skipped; the text is trimmed.
    """
    keys = F.map_keys(mapping)
    root = F.array_min(F.filter(keys, lambda k: mapping[k]["parent"].isNull() | ~F.array_contains(keys, mapping[k]["parent"])))
    zero = F.struct(root.alias("at"), F.array().cast("array<string>").alias("seen"))

    def walk(acc: Column, _: Column) -> Column:
        go = acc["at"].isNotNull() & ~F.array_contains(acc["seen"], acc["at"])
        child = F.get(mapping[acc["at"]]["children"], F.lit(0))
        return F.when(go, F.struct(child.alias("at"), F.array_append(acc["seen"], acc["at"]).alias("seen"))).otherwise(acc)

    path = F.aggregate(keys, zero, walk, lambda a: a["seen"])

    def text(parts: Column) -> Column:
        items = F.filter(F.from_json(parts, "array<string>"), lambda p: p.isNotNull() & ~p.startswith("{"))
        return F.regexp_replace(F.array_join(items, ""), r"^\s+|\s+$", "")

    turns = F.transform(path, lambda k: F.struct(mapping[k]["message"]["author"]["role"].alias("role"), F.coalesce(text(mapping[k]["message"]["content"]["parts"]), F.lit("")).alias("content")))
    return F.filter(turns, lambda t: t["role"].isin("user", "assistant") & (t["content"] != ""))


def tree_export(raw: DataFrame) -> DataFrame:
    """(id, title, messages) of exports whose conversations are trees of nodes."""
    x = raw.select(F.explode(F.from_json("value", TREE, {"mode": "FAILFAST"})).alias("c"))
    return x.select("c.id", "c.title", tree_messages(F.col("c.mapping")).alias("messages"))


def read_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions, one JSON file each, with `modified`; files that can't be read give no row."""
    x = spark.read.schema(S.SESSION + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(folder)
    x = x.select("*", F.col("_metadata.file_modification_time").alias("modified"))
    return x.filter(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()).drop("_corrupt_record")


def pull_request_learnings(prs: DataFrame, repo: str | Column) -> DataFrame:
    """Learnings of (number, title, state, merged_at, html_url, body, user, labels); `repo` is a name or a column."""
    repo = F.lit(repo) if isinstance(repo, str) else repo
    slug = F.translate(repo, "/_", "--")
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    body = F.trim(F.coalesce("body", F.lit("")))
    body = F.when(body == "", "no description").when(F.char_length(body) > 400, F.concat(F.substring(body, 1, 400), F.lit("…"))).otherwise(body)
    status = F.when(F.col("merged_at").isNotNull(), "merged").otherwise(F.col("state"))
    meta = F.concat(F.format_string("PR #%d [%s] %s @%s", "number", status, repo, "user"), F.when(F.size(labels) > 0, F.concat(F.lit(" labels:"), F.array_join(labels, ","))).otherwise(""))
    return prs.select(
        F.lit("knowledge").alias("category"), F.concat(F.lit("github-"), slug, F.lit("-pr-"), F.col("number").cast("string")).alias("topic"), F.concat(F.array(F.lit("github"), F.lit("pull-request"), slug), labels).alias("tags"),
        F.concat(meta, F.lit("\n"), "html_url", F.lit("\n"), body, F.lit("\n")).alias("content"), F.lit("high").alias("confidence"), F.lit("create").alias("action"), F.lit("module:github_prs").alias("source"),
    )


#: Connectors by name: a description, and a function of (spark, options) that gives learnings.
CONNECTORS: dict[str, tuple[str, Callable[[SparkSession, dict], DataFrame]]] = {}


def connector(name: str, description: str):
    def put(f):
        if name in CONNECTORS:
            raise ValueError(f"{name} is registered")
        CONNECTORS[name] = description, f
        return f

    return put


@connector("github_prs", "pull requests of repositories, from a service, saved pages or saved JSON lines")
def _pull_requests(spark: SparkSession, options: dict) -> DataFrame:
    if "repo" not in options:  # a service or pages: all that the data source finds
        register_sources(spark)
        return pull_request_learnings(spark.read.format("pull_requests").options(**options).load(), F.col("repo"))
    kind = "number int, title string, state string, merged_at string, html_url string, body string, user struct<login:string>, labels array<struct<name:string>>"
    x = spark.read.schema(kind).json(options["path"]).orderBy(F.desc("number")).limit(int(options.get("limit", 30)))
    return pull_request_learnings(x.withColumn("user", F.col("user.login")).withColumn("labels", F.transform("labels", lambda v: v["name"])), options["repo"])


@connector("google_sheets", "a range of a sheet, from a service or a saved values response")
def _sheet(spark: SparkSession, options: dict) -> DataFrame:
    from lexispark.functions.text import compact_sheet

    if "url" in options:
        register_sources(spark)
        x = spark.read.format("sheet_values").options(**options).load()
    else:
        x = spark.read.schema("range string, values array<array<string>>").option("multiLine", True).json(options["path"])
    sheet = options["sheet"]
    return x.select(
        F.lit("knowledge").alias("category"), F.lit(f"sheet-{sheet}").alias("topic"), F.array(F.lit("google-sheets")).alias("tags"), compact_sheet(F.lit(sheet), F.col("range"), F.col("values")).alias("content"),
        F.lit("high").alias("confidence"), F.lit("replace").alias("action"), F.lit("module:google_sheets").alias("source"),
    )
