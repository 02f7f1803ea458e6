"""Queries on importers, sessions, list lines, tables and other text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark import schema as S
from lexispark.functions import text as T
from lexispark.operators import summary as Y
from lexispark.runtime import read_table, scratch, spread
from lexispark.sources import exports as X
from lexispark.sources.connect import register_sources
from lexispark.sources.files import read_markdown
from lexispark.sources.sink import save_files

from .catalog import register

#: Ids on a saved page of pull requests.
PAGE = 5000

def _talks(spark, sf_dir):
    """(id, messages) of the conversations, by turn."""
    c = read_table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    x = c.groupBy("conv_id").agg(turns.alias("t"))
    return x.select(F.col("conv_id").cast("string").alias("id"), F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


_MESSAGES = "SELECT conv_id::VARCHAR AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role, text AS content FROM conversations"


@register("conv_import_flat", "SELECT conv_id::VARCHAR AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, text AS content FROM conversations WHERE text <> ''")
def conv_import_flat(spark, sf_dir):
    """Conversations written as a flat export and read again."""
    said = F.transform("messages", lambda m: F.struct(F.lit("u").alias("uuid"), F.when(m["role"] == "user", "human").otherwise(m["role"]).alias("sender"), m["content"].alias("text")))
    raw = _talks(spark, sf_dir).select(F.to_json(F.array(F.struct(F.col("id").alias("uuid"), F.lit("t").alias("name"), said.alias("chat_messages")))).alias("value"))
    return X.flat_export(raw).select("id", F.posexplode("messages").alias("position", "m")).select("id", F.col("position").cast("long").alias("position"), "m.role", "m.content")


@register("conv_import_tree", r"SELECT conv_id::VARCHAR AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content FROM conversations WHERE role <> 'system' AND text <> ''")
def conv_import_tree(spark, sf_dir):
    """Conversations written as trees, a node a turn, and read again."""

    def node(m, i):
        content = F.struct(F.lit("text").alias("content_type"), F.array(m["content"]).alias("parts"))
        parent = F.when(i > 0, F.format_string("n%05d", i - 1))
        return F.struct(F.format_string("n%05d", i).alias("id"), F.struct(F.struct(m["role"].alias("role")).alias("author"), content.alias("content")).alias("message"), parent.alias("parent"), F.when(i < F.size("messages") - 1, F.array(F.format_string("n%05d", i + 1))).otherwise(F.array().cast("array<string>")).alias("children"))

    nodes = F.map_from_entries(F.transform("messages", lambda m, i: F.struct(F.format_string("n%05d", i).alias("k"), node(m, i).alias("v"))))
    raw = _talks(spark, sf_dir).select(F.to_json(F.array(F.struct("id", F.lit("t").alias("title"), nodes.alias("mapping")))).alias("value"))
    return X.tree_export(raw).select("id", F.posexplode("messages").alias("position", "m")).select("id", F.col("position").cast("long").alias("position"), "m.role", "m.content")


@register("conv_hash", "SELECT conv_id::VARCHAR AS id, sha256(string_agg(role || ':' || text || chr(10), '' ORDER BY turn))[:16] AS hash FROM conversations GROUP BY conv_id")
def conv_hash(spark, sf_dir):
    return _talks(spark, sf_dir).select("id", T.conversation_hash(F.col("messages")).alias("hash"))


@register("session_flatten", f"SELECT * FROM ({_MESSAGES}) WHERE content <> ''")
def session_flatten(spark, sf_dir):
    return Y.flat_messages(_talks(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


@register("last_n_messages", f"SELECT * FROM ({_MESSAGES}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY position DESC) <= 2")
def last_n_messages(spark, sf_dir):
    return Y.last_messages(Y.flat_messages(_talks(spark, sf_dir)), 2).withColumn("position", F.col("position").cast("long"))


@register("last_exchange", f"""SELECT id, CASE WHEN length(q) > 200 THEN q[:200] || '...' ELSE q END AS question, CASE WHEN length(a) > 200 THEN a[:200] || '...' ELSE a END AS answer FROM (
  SELECT id, coalesce(arg_max(content, position) FILTER (role = 'user'), '') AS q, coalesce(arg_max(content, position) FILTER (role = 'assistant'), '') AS a FROM ({_MESSAGES}) WHERE id = (SELECT max(conv_id::VARCHAR) FROM conversations) GROUP BY id)""")
def last_exchange(spark, sf_dir):
    return Y.last_exchange(_talks(spark, sf_dir))


@register("import_counts", "SELECT count_if(conv_id % 3 > 0 AND conv_id % 7 <> 2) AS processed, count_if(conv_id % 3 = 0) AS unchanged, 0::BIGINT AS empty, count_if(conv_id % 3 > 0 AND conv_id % 7 = 2) AS failed FROM (SELECT DISTINCT conv_id FROM conversations)")
def import_counts(spark, sf_dir):
    """A manifest that knows every third conversation, and the next one by an older hash; the import of every seventh failed."""
    t = _talks(spark, sf_dir)
    n = F.col("id").cast("long") % 3
    done = t.filter(n < 2).select("id", F.when(n == 0, T.conversation_hash(F.col("messages"))).otherwise("older").alias("hash"))
    return Y.import_counts(t, done, t.filter(F.col("id").cast("long") % 7 == 2).select("id"))


# ---- task and goal lists, made from orders ----

_CR = "chr(10)"


def _boards(spark, sf_dir):
    """A board for each customer: a heading, a task and a goal line for each order."""
    o = read_table(spark, sf_dir, "orders")
    k, done = F.col("o_orderkey").cast("string"), F.col("o_orderstatus") == "F"
    mark = F.when(F.col("o_orderkey") % 3 == 0, "\U0001f534 ").when(F.col("o_orderkey") % 3 == 1, "\U0001f7e2 ").otherwise("")
    task = F.concat(F.when(done, "- [x] ").otherwise("- [ ] "), mark, F.lit("ship "), k)
    goal = F.concat(F.when(done, "- [x] [").otherwise("- [ ] ["), F.when(F.col("o_orderkey") % 2 == 0, "short").otherwise("long"), F.lit("] close "), k)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.concat(task, F.lit("\n"), goal).alias("line")))), lambda x: x["line"]), "\n")
    return o.groupBy(F.col("o_custkey").alias("board")).agg(F.concat(F.lit("# Board\n"), lines, F.lit("\n")).alias("text"))


_MARK = "CASE o_orderkey % 3 WHEN 0 THEN '\U0001f534 ' WHEN 1 THEN '\U0001f7e2 ' ELSE '' END"
_BOX = "CASE o_orderstatus WHEN 'F' THEN '- [x] ' ELSE '- [ ] ' END"
_TASK = f"{_BOX} || {_MARK} || 'ship ' || o_orderkey"
_GOAL = f"{_BOX} || '[' || CASE o_orderkey % 2 WHEN 0 THEN 'short' ELSE 'long' END || '] close ' || o_orderkey"
_RANKED = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders"


def _board_sql(task: str, goal: str = _GOAL) -> str:
    line = f"CASE WHEN ({task}) IS NULL THEN '' ELSE ({task}) || {_CR} END || {goal}"
    return f"SELECT o_custkey AS board, '# Board' || {_CR} || string_agg({line}, {_CR} ORDER BY o_orderkey) || {_CR} AS text FROM ({_RANKED}) GROUP BY o_custkey"


# both kinds of lines are tasks to the task pattern, so task 2n is order n's task and 2n + 1 its goal
@register("parse_tasks", f"""SELECT o_custkey AS board, {_MARK} || 'ship ' || o_orderkey AS text, o_orderstatus = 'F' AS done, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE '' END AS priority FROM orders
  UNION ALL SELECT o_custkey, '[' || CASE o_orderkey % 2 WHEN 0 THEN 'short' ELSE 'long' END || '] close ' || o_orderkey, o_orderstatus = 'F', '' FROM orders""")
def parse_tasks(spark, sf_dir):
    return _boards(spark, sf_dir).select("board", F.explode(T.parse_tasks(F.col("text"))).alias("t")).select("board", "t.text", "t.done", "t.priority")


@register("parse_goals", "SELECT o_custkey AS board, 'close ' || o_orderkey AS text, CASE o_orderkey % 2 WHEN 0 THEN 'short' ELSE 'long' END AS horizon, o_orderstatus = 'F' AS done FROM orders")
def parse_goals(spark, sf_dir):
    return _boards(spark, sf_dir).select("board", F.explode(T.parse_goals(F.col("text"))).alias("g")).select("board", "g.text", "g.horizon", "g.done")


@register("task_summary", "SELECT 'tasks/' || o_custkey AS path, 2 * count_if(o_orderstatus = 'F') AS done, 2 * count(*) AS total FROM orders GROUP BY o_custkey")
def task_summary(spark, sf_dir):
    b = _boards(spark, sf_dir).select(F.concat(F.lit("tasks/"), F.col("board").cast("string")).alias("path"), F.col("text").alias("content"))
    return Y.task_summary(b)


@register("toggle_task", _board_sql(f"CASE WHEN n = 0 THEN regexp_replace({_TASK}, '\\[[ x~]\\]', '[x]', 'g') ELSE {_TASK} END"))
def toggle_task(spark, sf_dir):
    return _boards(spark, sf_dir).select("board", T.toggle_task(F.col("text"), F.lit(0), F.lit(True)).alias("text"))


@register("remove_task", _board_sql(f"CASE WHEN n = 0 THEN NULL ELSE {_TASK} END"))
def remove_task(spark, sf_dir):
    return _boards(spark, sf_dir).select("board", T.remove_task(F.col("text"), F.lit(0)).alias("text"))


@register("append_task", f"SELECT board, text || '- [ ] \U0001f7e1 review' || {_CR} AS text FROM ({_board_sql(_TASK)})")
def append_task(spark, sf_dir):
    return _boards(spark, sf_dir).select("board", T.append_task(F.col("text"), F.lit("review"), F.lit("medium")).alias("text"))


@register("toggle_goal", _board_sql(_TASK, f"CASE WHEN n = 0 THEN '- [ ] ' || ({_GOAL})[7:] ELSE {_GOAL} END"))
def toggle_goal(spark, sf_dir):
    return _boards(spark, sf_dir).select("board", T.toggle_goal(F.col("text"), F.lit(0), F.lit(False)).alias("text"))


# ---- tables and small functions ----


@register("md_escape", r"SELECT page_id, replace(replace(replace(replace(trim(regexp_replace(html, '\s+', ' ', 'g')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '\|') AS cell FROM pages")
def md_escape(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", T.escape_cell(F.col("html")).alias("cell"))


@register("md_table", f"SELECT n_regionkey AS region, '| key | name |' || {_CR} || '| --- | --- |' || {_CR} || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |' || {_CR}, '' ORDER BY n_nationkey) AS table_text FROM nation GROUP BY n_regionkey")
def md_table(spark, sf_dir):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"]))
    x = read_table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(rows.alias("rows"))
    return x.select("region", T.markdown_table(F.array(F.lit("key"), F.lit("name")), F.col("rows")).alias("table_text"))


@register("sheet_table", f"SELECT n_regionkey AS region, 'sheet:s range:A1' || {_CR} || string_agg(n_nationkey || ' | ' || n_name || {_CR}, '' ORDER BY n_nationkey) AS table_text FROM nation GROUP BY n_regionkey")
def sheet_table(spark, sf_dir):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.array(r["n_nationkey"].cast("string"), F.concat(F.lit(" "), r["n_name"])))
    blank = F.array(F.array(F.lit(" "), F.lit("")))
    x = read_table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.concat(rows, blank).alias("rows"))
    return x.select("region", T.compact_sheet(F.lit("s"), F.lit("A1"), F.col("rows")).alias("table_text"))


_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@register("snippet", f"SELECT doc_id, CASE WHEN length({_TRIM}) > 200 THEN {_TRIM}[:200] || '...' ELSE {_TRIM} END AS snippet, split_part({_TRIM}, {_CR}, 1) AS first_line FROM documents")
def snippet(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.first_line(F.col("text")).alias("first_line"))


@register("since_parse", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULLIF(event_id % 50, 0) WHEN 1 THEN 7 * (event_id % 50) END AS days FROM events")
def since_parse(spark, sf_dir):
    n = (F.col("event_id") % 50).cast("string")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(n, F.lit("d"))).when(k == 1, F.concat(F.lit(" "), n, F.lit("W "))).when(k == 2, F.concat(n, F.lit(".5d"))).otherwise("invalid")
    return read_table(spark, sf_dir, "events").select("event_id", T.since_days(text).cast("long").alias("days"))


@register("semver_cmp", "SELECT event_id, event_id % 7 > 3 OR (event_id % 7 = 3 AND event_id % 11 > 5) AS newer FROM events")
def semver_cmp(spark, sf_dir):
    v = F.concat(F.lit("v1."), (F.col("event_id") % 7).cast("string"), F.lit("."), (F.col("event_id") % 11).cast("string"))
    return read_table(spark, sf_dir, "events").select("event_id", T.newer_version(v, F.lit("1.3.5")).alias("newer"))


@register("pr_learning", f"""SELECT 'github-a-b-c-pr-' || o_orderkey AS topic, 'PR #' || o_orderkey || ' [' || CASE o_orderstatus WHEN 'F' THEN 'merged' ELSE 'open' END || '] a/b_c @u' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ' labels:' || o_orderpriority ELSE '' END || {_CR} || 'https://x/' || o_orderkey || {_CR} || 'no description' || {_CR} AS content FROM orders""")
def pr_learning(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    prs = o.select(
        F.col("o_orderkey").cast("int").alias("number"), F.lit("t").alias("title"), F.lit("open").alias("state"), F.when(F.col("o_orderstatus") == "F", "x").alias("merged_at"), F.concat(F.lit("https://x/"), F.col("o_orderkey").cast("string")).alias("html_url"),
        F.lit(" ").alias("body"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user"), F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderpriority")).alias("labels"),
    )
    return X.pull_request_learnings(prs, "a/b_c").select("topic", "content")


@register("pr_source", f"""
SELECT 'github-' || translate(source || '-' || lang, '/_', '--') || '-pr-' || doc_id AS topic,
  'PR #' || doc_id || ' [' || CASE WHEN doc_id % 3 = 0 THEN 'merged' ELSE 'open' END || '] ' || source || '/' || lang || ' @' || source || ' labels:' || lang || {_CR} || 'https://x/' || doc_id || {_CR}
  || CASE WHEN b = '' THEN 'no description' WHEN length(b) > 400 THEN b[:400] || '…' ELSE b END || {_CR} AS content
FROM (SELECT *, trim(text, ' ') AS b FROM documents)""")
def pr_source(spark, sf_dir):
    """Documents as pull requests of a repository for each source and language: saved as pages of JSON, then read by the data source."""
    d, pages = read_table(spark, sf_dir, "documents"), scratch(spark, "pages")
    pr = F.struct(
        F.col("doc_id").alias("number"), F.lit("t").alias("title"), F.lit("open").alias("state"), F.when(F.col("doc_id") % 3 == 0, "x").alias("merged_at"), F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")).alias("html_url"),
        F.col("text").alias("body"), F.struct(F.col("source").alias("login")).alias("user"), F.array(F.struct(F.col("lang").alias("name"))).alias("labels"),
    )
    page = d.select(F.concat_ws("/", "source", "lang").alias("repo"), (F.floor(F.col("doc_id") / PAGE) + 1).alias("page"), pr.alias("pr"))
    page.groupBy("repo", "page").agg(F.to_json(F.collect_list("pr")).alias("value")).write.partitionBy("repo", "page").text(pages)
    register_sources(spark)
    prs = spark.read.format("pull_requests").option("path", pages).load()
    return X.pull_request_learnings(prs, F.col("repo")).select("topic", "content")


@register("sink_commit", f"""
SELECT replace(path, '.md', CASE WHEN doc_id % 4 = 1 THEN '-kept.md' ELSE '.md' END) AS path, sha256(CASE WHEN doc_id % 4 = 2 THEN 'second ' ELSE '' END || ltrim(content, {_CR})) AS sha
FROM (SELECT 'knowledge/doc-' || doc_id || '.md' AS path, doc_id, text AS content FROM documents) WHERE doc_id % 4 > 0""")
def sink_commit(spark, sf_dir):
    """All documents as files; then a second write that trashes, moves and replaces some; the files as they are after it."""
    d, root = read_table(spark, sf_dir, "documents"), scratch(spark, "files")
    k, path = F.col("doc_id") % 4, F.concat(F.lit("knowledge/doc-"), F.col("doc_id").cast("string"))
    raw = F.regexp_replace("text", "^\n+", "")
    save_files(d.select(F.concat(path, F.lit(".md")).alias("path"), raw.alias("raw")), root)
    moved = d.filter(k == 1).select(F.concat(path, F.lit("-kept.md")).alias("path"), raw.alias("raw"))
    save_files(d.filter(k != 3).select(F.concat(path, F.lit(".md")).alias("path"), F.when(k == 2, F.concat(F.lit("second "), raw)).alias("raw")).unionByName(moved), root)
    return read_markdown(spark, root).select("path", F.sha2("content", 256).alias("sha"))


@register("symbols_regex", "SELECT p_partkey AS part, unnest(['f', 'C', 'g', 'T', 'h', 'm', 'S']) || p_partkey AS name, unnest(['func', 'type', 'func', 'type', 'func', 'method', 'type']) AS kind FROM part")
def symbols_regex(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    src = {
        "py": F.concat(F.lit("def f"), k, F.lit("(x):\n    def inner(): pass\nclass C"), k, F.lit(":\n")),
        "ts": F.concat(F.lit("export async function g"), k, F.lit("() {}\nexport interface T"), k, F.lit(" {}\n")),
        "go": F.concat(F.lit("func h"), k, F.lit("() {}\nfunc (r *S) m"), k, F.lit("() {}\ntype S"), k, F.lit(" struct {}\n")),
    }
    found = F.concat(*(T.symbols(s, lang) for lang, s in src.items()))
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.explode(found).alias("s")).select("part", "s.name", "s.kind")


@register("auto_tags", f"SELECT p_partkey AS part, 'alpha,beta,mid-part' || p_partkey || ',part' || p_partkey || '-word' AS tags FROM part")
def auto_tags(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("# The Beta, alpha\n\nIn mid part"), k, F.lit(" word.\n## alpha\nbeta words here\n## beta\n"))
    return spread(read_table(spark, sf_dir, "part").select("p_partkey")).select(F.col("p_partkey").alias("part"), F.array_join(T.auto_tags(text), ",").alias("tags"))


@register("title_case", "SELECT n_nationkey AS nation, 'My BIG ' || replace(upper(lower(n_name)[1]) || lower(n_name)[2:], '_', ' ') AS title FROM nation")
def title_case(spark, sf_dir):
    slug = F.concat(F.lit("my-BIG-"), F.replace(F.lower("n_name"), F.lit(" "), F.lit("_")))
    return read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.replace(T.title_of_slug(slug), F.lit("_"), F.lit(" ")).alias("title"))


def _wrapped(spark, sf_dir):
    """Learnings as an assistant returns them: JSON in prose, with brackets in strings."""
    c = spread(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    item = F.struct(F.lit("knowledge").alias("category"), F.col("c_name").alias("topic"), F.array(F.lit("x]"), F.lit('"y[')).alias("tags"), F.concat(F.lit("[note] \\ "), "c_name").alias("content"), F.lit("high").alias("confidence"), F.lit("create").alias("action"), F.lit("s").alias("source"))
    return c.select("c_custkey", F.concat(F.lit(" Here it is:\n```json\n"), F.to_json(F.array(item, item)), F.lit("\n``` [done]")).alias("raw"))


_ITEM = """'{"category":"knowledge","topic":"' || c_name || '","tags":["x]","\\"y["],"content":"[note] \\\\ ' || c_name || '","confidence":"high","action":"create","source":"s"}'"""


@register("json_array_extract", f"SELECT c_custkey, '[' || {_ITEM} || ',' || {_ITEM} || ']' AS json FROM customer")
def json_array_extract(spark, sf_dir):
    return _wrapped(spark, sf_dir).select("c_custkey", T.json_array(F.col("raw")).alias("json"))


@register("parse_learnings", "SELECT c_custkey, n, c_name AS topic, '[note] \\ ' || c_name AS content FROM customer, (VALUES (0), (1)) v(n)")
def parse_learnings(spark, sf_dir):
    x = _wrapped(spark, sf_dir).select("c_custkey", F.posexplode(F.from_json(T.json_array(F.col("raw")), S.LEARNINGS)).alias("n", "l"))
    return x.select("c_custkey", "n", "l.topic", "l.content")
