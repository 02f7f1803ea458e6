"""Queries on duplicates, categories, plans, decay, learnings, increments and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark import schema as S
from lexispark.functions import text as T
from lexispark.operators import index as I
from lexispark.operators import maintenance as M
from lexispark.operators import prompts as P
from lexispark.operators import search as R
from lexispark.operators import summary as Y
from lexispark.operators.segments import SegmentedCorpus
from lexispark.runtime import read_table, scratch

from .catalog import register
from .corpus import AS_OF, _list, as_of, knowledge_files, sql_tokens, with_sql


def _index(spark, sf_dir):
    return I.build_index(knowledge_files(spark, sf_dir), keep=True)


_SAT = "frequency * 2.5 / (frequency + 1.5 * (0.5 + 0.5 * word_count / avg_doc))"
_VECTORS = {
    "p": "SELECT * FROM content_p UNION ALL SELECT * FROM tag_p",
    "idf": "SELECT term, ln((any_value(n_docs) - count(DISTINCT path) + 0.5) / (count(DISTINCT path) + 0.5) + 1) AS idf FROM p, stats GROUP BY term",
    "raw": f"SELECT path, term, sum(idf * {_SAT} * CASE field WHEN 'tag' THEN 3 ELSE 1 END) AS w FROM p JOIN idf USING (term) JOIN sized USING (path), stats GROUP BY path, term",
    "v": "SELECT path, term, w / sqrt(sum(w * w) OVER (PARTITION BY path)) AS w FROM raw",
    "pairs": "SELECT a, b, s FROM (SELECT a.path AS a, b.path AS b, sum(a.w * b.w) AS s FROM v a JOIN v b ON a.term = b.term AND a.path < b.path GROUP BY ALL) WHERE s >= 0.7 - 1e-9",
}
_BASE = "docs content_p tag_p sized stats"


def _components(edges: str) -> dict[str, str]:
    return {
        "near": f"SELECT a AS x, b AS y FROM {edges} UNION SELECT b, a FROM {edges}",
        "walk": "SELECT x, x AS y FROM near UNION SELECT walk.x, near.y FROM walk JOIN near ON walk.y = near.x",
        "members": "SELECT x AS path, min(y) AS cluster FROM walk GROUP BY x",
    }


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_TARGETS = {"targets": "SELECT cluster, path AS target FROM members JOIN docs USING (path) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY access_count DESC, updated DESC, strlen(content) DESC, path) = 1"}


@register("doc_cosine_pairs", with_sql(_BASE, "SELECT a, b, round(s, 6) AS similarity FROM pairs", _VECTORS))
def doc_cosine_pairs(spark, sf_dir):
    x = M.duplicate_pairs(I.build_index(knowledge_files(spark, sf_dir)), 0.7)
    return x.select("a", "b", F.round("similarity", 6).alias("similarity"))


@register("dedup_components", _recursive(with_sql(_BASE, "SELECT path, cluster FROM members", _VECTORS | _components("pairs"))))
def dedup_components(spark, sf_dir):
    return M.duplicate_clusters(I.build_index(knowledge_files(spark, sf_dir)), 0.7)


@register("best_target", _recursive(with_sql(_BASE, "SELECT cluster, target FROM targets", _VECTORS | _components("pairs") | _TARGETS)))
def best_target(spark, sf_dir):
    x = I.build_index(knowledge_files(spark, sf_dir))
    return M.best_targets(M.duplicate_clusters(x, 0.7), x.docs)


@register("dedup_plan", _recursive(with_sql(_BASE, """SELECT 'merge' AS type, path AS source_path, target AS target_path, round(similarity, 6) AS similarity FROM members JOIN targets USING (cluster)
  JOIN (SELECT cluster, avg(s) AS similarity FROM pairs JOIN members ON path = a GROUP BY cluster) USING (cluster) WHERE path <> target""", _VECTORS | _components("pairs") | _TARGETS)))
def dedup_plan(spark, sf_dir):
    return M.duplicate_plan(I.build_index(knowledge_files(spark, sf_dir))).withColumn("similarity", F.round("similarity", 6))


_SMALL = {**_VECTORS, "pairs": "SELECT a, b FROM (SELECT a.path AS a, b.path AS b, sum(a.w * b.w) AS s FROM v a JOIN sized za ON za.path = a.path AND za.word_count < 50 JOIN v b ON a.term = b.term AND a.path < b.path AND string_split(a.path, '/')[1] = string_split(b.path, '/')[1] JOIN sized zb ON zb.path = b.path AND zb.word_count < 50 GROUP BY ALL) WHERE s >= 0.35 - 1e-9"}


@register("consolidate_plan", _recursive(with_sql(_BASE, "SELECT 'consolidate' AS type, path AS source_path, target AS target_path FROM members JOIN targets USING (cluster) WHERE path <> target", _SMALL | _components("pairs") | _TARGETS)))
def consolidate_plan(spark, sf_dir):
    return M.consolidation_plan(I.build_index(knowledge_files(spark, sf_dir)))


_SIGNAL = ", ".join(f"('{w}', '{c}')" for c, ws in S.CATEGORY_KEYWORDS.items() for w in ws)
_MARKED = "content || CASE doc_id % 3 WHEN 0 THEN ' why because reason decided' WHEN 1 THEN ' style format layout' ELSE '' END"


def _marked(spark, sf_dir):
    """Files with some category words, which the documents lack."""
    extra = F.when(F.col("n") % 3 == 0, " why because reason decided").when(F.col("n") % 3 == 1, " style format layout").otherwise("")
    x = knowledge_files(spark, sf_dir).withColumn("n", F.regexp_extract("path", r"doc-(\d+)\.md", 1).cast("long"))
    return x.withColumn("content", F.concat("content", extra)).drop("n")


_SCORES = {
    "signal": f"SELECT * FROM (VALUES {_SIGNAL}) s(token, cat)",
    "marked": f"SELECT *, {_MARKED} || ' ' || array_to_string(tags, ' ') AS whole FROM docs",
    "scores": f"SELECT path, cat, count(*) AS score FROM (SELECT path, unnest({sql_tokens('whole')}) AS token FROM marked WHERE list_contains({_list(S.CATEGORY_KEYWORDS)}, category)) JOIN signal USING (token) GROUP BY path, cat",
}


@register("recategorize_scores", with_sql("docs", "SELECT path, cat AS category, score FROM scores", _SCORES))
def recategorize_scores(spark, sf_dir):
    d = _marked(spark, sf_dir)
    return M.keyword_counts(d.filter(F.split("path", "/")[0].isin(list(S.CATEGORY_KEYWORDS))))


_RANK = f"list_position({_list(S.CATEGORIES)}, {{}})"


@register("recategorize_plan", with_sql("docs", f"""SELECT path, category, cat AS best, s.score AS best_score, coalesce(n.score, 0) AS current_score, cat || path[length(category) + 1:] AS target_path
  FROM (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, {_RANK.format('cat')}) = 1) s JOIN docs USING (path)
  LEFT JOIN (SELECT path, cat AS category, score FROM scores) n USING (path, category) WHERE cat <> category AND s.score > coalesce(n.score, 0) AND s.score >= coalesce(n.score, 0) * 1.3 + 2""", _SCORES))
def recategorize_plan(spark, sf_dir):
    return M.recategorize_plan(_marked(spark, sf_dir))


def _lost(spark, sf_dir):
    """The first third of each four files under folders that are no categories, or under none."""
    n = F.regexp_extract("path", r"doc-(\d+)\.md", 1).cast("long")
    rest = F.expr("substring(path, instr(path, '/') + 1)")
    return _marked(spark, sf_dir).withColumn("path", F.when(n % 4 == 0, F.concat(F.lit("misc/"), rest)).when(n % 4 == 1, F.substring_index("path", "/", -1)).otherwise(F.col("path")))


@register("migrate_plan", with_sql("docs", f"""SELECT m.path AS source_path, CASE WHEN t.path IS NULL THEN 'move' ELSE 'consolidate' END AS type, target AS target_path, round(coalesce(confidence, 0), 6) AS confidence, coalesce(confidence, 0) < 0.4 AS low_confidence
  FROM (SELECT path, coalesce(cat, 'knowledge') || '/' || name AS target, score / total AS confidence FROM lost LEFT JOIN best USING (path)) m LEFT JOIN moved t ON t.path = target""", {
    "signal": _SCORES["signal"],
    "moved": f"SELECT CASE doc_id % 4 WHEN 0 THEN 'misc/' || source || '/doc-' || doc_id || '.md' WHEN 1 THEN 'doc-' || doc_id || '.md' ELSE path END AS path, doc_id, source, tags, {_MARKED} AS content FROM docs",
    "lost": "SELECT path, CASE doc_id % 4 WHEN 0 THEN source || '/' ELSE '' END || 'doc-' || doc_id || '.md' AS name, content || ' ' || array_to_string(tags, ' ') || ' doc ' || doc_id AS whole FROM moved WHERE doc_id % 4 < 2",
    "scores": f"SELECT path, cat, count(*) AS score FROM (SELECT path, unnest({sql_tokens('whole')}) AS token FROM lost) JOIN signal USING (token) GROUP BY path, cat",
    "best": f"SELECT path, cat, score, sum(score) OVER (PARTITION BY path) AS total FROM scores QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, {_RANK.format('cat')}) = 1",
}))
def migrate_plan(spark, sf_dir):
    return Y.low_confidence(M.migrate_plan(_lost(spark, sf_dir))).withColumn("confidence", F.round("confidence", 6))


@register("reorg_combined")
def reorg_combined(spark, sf_dir):
    """All three plans in one, each source used once."""
    x = I.build_index(_marked(spark, sf_dir))
    cols = ["type", "source_path", "target_path"]
    moves = M.recategorize_plan(x.docs).select(F.lit("move").alias("type"), F.col("path").alias("source_path"), "target_path")
    vectors = M.document_rows(x.docs, M.category(x.docs))  # counted once for both plans
    rows = M.duplicate_plan(x, rows=vectors).select(cols).unionByName(M.consolidation_plan(x, rows=vectors)).unionByName(moves)
    return M.combine_plans(rows)


_DAYS = f"(DATE '{AS_OF}' - updated)"
_NEW = f"CASE WHEN confidence = 'high' AND {_DAYS} >= 180 THEN 'medium' WHEN confidence = 'medium' AND {_DAYS} >= 365 THEN 'low' ELSE confidence END"


@register("decay_report", with_sql("docs", f"SELECT path, confidence AS old_confidence, {_NEW} AS new_confidence, {_DAYS} AS days FROM docs WHERE confidence <> {_NEW}"))
def decay_report(spark, sf_dir):
    return M.decay_report(knowledge_files(spark, sf_dir), as_of())


@register("decay_apply", with_sql("docs", f"SELECT path, {_NEW} AS confidence FROM docs"))
def decay_apply(spark, sf_dir):
    return M.decay(knowledge_files(spark, sf_dir), as_of()).select("path", "confidence")


@register("learn_upsert", with_sql("docs", f"""
  SELECT path, array_to_string(tags, ',') AS tags, confidence, source, content FROM docs WHERE doc_id % 5 > 0
  UNION ALL SELECT path, array_to_string(tags, ',') || ',new', confidence, source, rtrim(content, chr(10)) || chr(10) || chr(10) || 'Learned ' || doc_id || chr(10) FROM docs WHERE doc_id % 10 = 0
  UNION ALL SELECT path, 'new', 'low', 'conversation', chr(10) || 'Learned ' || doc_id || chr(10) FROM docs WHERE doc_id % 10 = 5
  UNION ALL SELECT category || '/fresh-' || doc_id || '.md', 'new', 'low', 'conversation', chr(10) || 'Learned ' || doc_id || chr(10) FROM docs WHERE doc_id % 7 = 0"""))
def learn_upsert(spark, sf_dir):
    """Appends to every tenth file, replaces the fifth after it, and new files for every seventh."""
    d = knowledge_files(spark, sf_dir)
    n = F.regexp_extract("path", r"doc-(\d+)\.md", 1).cast("long")
    x = d.select(n.alias("n"), F.split("path", "/")[0].alias("category"), F.expr("substring(path, instr(path, '/') + 1)").alias("topic"))
    row = lambda topic, action: x.select("n", "category", topic.alias("topic"), F.lit(action).alias("action"))
    old = F.regexp_replace("topic", r"\.md$", "")
    news = row(old, "append").filter("n % 10 = 0").unionByName(row(old, "replace").filter("n % 10 = 5")).unionByName(row(F.concat(F.lit("fresh-"), "n"), "create").filter("n % 7 = 0"))
    news = news.unionByName(x.select("n", F.lit("nowhere").alias("category"), "topic", F.lit("create").alias("action")))
    news = news.select(F.col("n").alias("seq"), "category", "topic", F.array(F.lit("new")).alias("tags"), F.concat(F.lit("Learned "), "n").alias("content"), F.lit("low").alias("confidence"), "action")
    return M.learn(d, news, AS_OF).select("path", F.array_join("tags", ",").alias("tags"), "confidence", "source", "content")


@register("merge_tags", with_sql("docs", "SELECT path, array_to_string(list_concat(tags, list_filter(['en', category], lambda t: NOT list_contains(tags, t))), ',') AS tags FROM docs"))
def merge_tags(spark, sf_dir):
    x = knowledge_files(spark, sf_dir)
    return x.select("path", F.array_join(T.merge_tags(F.col("tags"), F.array(F.lit("en"), F.split("path", "/")[0])), ",").alias("tags"))


@register("touch", with_sql("docs", f"SELECT path, access_count + (doc_id % 3 = 0)::INT AS access_count, CASE WHEN doc_id % 3 = 0 THEN '{AS_OF}' END AS last_accessed FROM docs"))
def touch(spark, sf_dir):
    d = knowledge_files(spark, sf_dir)
    used = d.filter(F.regexp_extract("path", r"doc-(\d+)\.md", 1).cast("long") % 3 == 0)
    return R.touch(d, used, as_of()).select("path", "access_count", F.col("last_accessed").cast("string").alias("last_accessed"))


def _earlier(d):
    """An earlier version: other texts in every tenth file, a missing file of each eleven, and some files that are gone."""
    n = F.regexp_extract("path", r"doc-(\d+)\.md", 1).cast("long")
    gone = d.filter(n % 13 == 0).withColumn("path", F.concat(F.lit("tasks/gone-"), n.cast("string"), F.lit(".md")))
    return d.filter(n % 11 != 3).withColumn("content", F.when(n % 10 == 1, F.concat(F.lit("earlier "), "content")).otherwise(F.col("content"))).unionByName(gone)


def _states(spark, sf_dir):
    d = knowledge_files(spark, sf_dir)
    old = _earlier(d)
    return d, old, I.manifest_diff(I.file_hashes(old), I.file_hashes(d))


@register("manifest_diff", with_sql("docs", "SELECT path, CASE WHEN doc_id % 11 = 3 OR doc_id % 10 = 1 THEN 'dirty' ELSE 'unchanged' END AS state FROM docs UNION ALL SELECT 'tasks/gone-' || doc_id || '.md', 'deleted' FROM docs WHERE doc_id % 13 = 0"))
def manifest_diff(spark, sf_dir):
    return _states(spark, sf_dir)[2]


@register("content_hashes", with_sql("docs", "SELECT path, sha256(content)[:24] AS hash FROM docs"))
def content_hashes(spark, sf_dir):
    return knowledge_files(spark, sf_dir).select("path", T.content_hash(F.col("content")).alias("hash"))


@register("delta_postings", with_sql("postings", "SELECT term, path, field, chunk_id, frequency FROM postings"))
def delta_postings(spark, sf_dir):
    """Postings kept up to date from an earlier version; the SQL builds them anew."""
    d, old, diff = _states(spark, sf_dir)
    return I.delta_index(I.build_index(old), d, diff).postings  # one table, so chunks aren't kept


@register("delta_segments", with_sql("postings", "SELECT term, path, field, chunk_id, frequency FROM postings"))
def delta_segments(spark, sf_dir):
    """Postings of a corpus on disk in its second version, which wrote what changed; the SQL builds them anew."""
    d, old, _ = _states(spark, sf_dir)
    corpus = SegmentedCorpus(spark, scratch(spark, "segments"))
    corpus.publish(old)
    corpus.publish(d)
    return corpus.current().postings


@register("vec_merge", "SELECT 'v' || vec_id AS path, 0 AS chunk_id, CASE WHEN vec_id % 5 = 0 THEN 'delta' ELSE 'base' END AS origin FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 5 = 0")
def vec_merge(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path"), F.lit(0).alias("chunk_id"), "vec_id")
    base, delta = e.withColumn("origin", F.lit("base")), e.filter("vec_id % 5 = 0").withColumn("origin", F.lit("delta"))
    return I.merge_vectors(base.drop("vec_id"), e.filter("vec_id % 7 = 0").select("path"), delta.drop("vec_id"))


@register("embedding_texts", with_sql("docs chunk", r"SELECT path, chunk_id, 'Tags: ' || array_to_string(tags, ', ') || '. ' || array_to_string(ws, ' ') AS text FROM chunk JOIN docs USING (path)"))
def embedding_texts(spark, sf_dir):
    d = knowledge_files(spark, sf_dir)
    x = I.embedding_texts(d, I.chunk_table(d))
    return x.select("path", "chunk_id", F.regexp_replace("text", r"\s+", " ").alias("text"))


# ---- reports ----


@register("overview", with_sql("docs sized stats", "SELECT n_docs AS files, (SELECT sum(word_count)::BIGINT FROM sized) AS words, n_chunks::BIGINT AS chunks, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM docs)) AS tags, CASE WHEN n_chunks > 0 THEN 'ok' ELSE 'stale' END AS health FROM stats"))
def overview(spark, sf_dir):
    x = _index(spark, sf_dir)
    return Y.overview(x.docs, x.documents)


@register("category_counts", with_sql("docs", "SELECT category, count(*) AS files FROM docs GROUP BY category"))
def category_counts(spark, sf_dir):
    return Y.category_counts(knowledge_files(spark, sf_dir))


@register("activity_top20", with_sql("docs", "SELECT path, updated::VARCHAR AS updated, access_count, confidence FROM docs ORDER BY updated DESC, access_count DESC, path LIMIT 20"))
def activity_top20(spark, sf_dir):
    return Y.activity(knowledge_files(spark, sf_dir)).withColumn("updated", F.col("updated").cast("string"))


@register("tag_counts_top50", with_sql("docs", "SELECT tag, count(*) AS files FROM (SELECT unnest(tags) AS tag FROM docs) GROUP BY tag ORDER BY files DESC, tag LIMIT 50"))
def tag_counts_top50(spark, sf_dir):
    return Y.tag_counts(knowledge_files(spark, sf_dir))


@register("file_listing", with_sql("docs sized", "SELECT path, array_to_string(tags, ',') AS tags, confidence, updated::VARCHAR AS updated, word_count::BIGINT AS word_count, chunk_count FROM docs JOIN sized USING (path)"))
def file_listing(spark, sf_dir):
    x = _index(spark, sf_dir)
    return Y.file_listing(x.docs, x.documents).withColumns({"tags": F.array_join("tags", ","), "updated": F.col("updated").cast("string")})


@register("prompt_context", with_sql("docs", "SELECT row_number() OVER (ORDER BY (category <> 'style')::INT, path) AS position, '### ' || path || chr(10) || CASE WHEN length(content) > 300 THEN content[:300] || '...' ELSE content END || chr(10) AS block FROM docs"))
def prompt_context(spark, sf_dir):
    return P.prompt_context(knowledge_files(spark, sf_dir))


_HEAD = "Read this."
_BARE = r"regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')"


def _sql_entry(most: int) -> str:
    bare = _BARE.format("content")
    return f"'### ' || path || chr(10) || CASE WHEN length({bare}) > {most} THEN {bare}[:{most}] || '...' ELSE {bare} END || chr(10) || chr(10)"


@register("contradiction_prompts", with_sql("docs", f"SELECT category, batch, '{_HEAD} ' || category || chr(10) || chr(10) || string_agg({_sql_entry(400)}, '' ORDER BY path) AS prompt FROM (SELECT category, path, content, (row_number() OVER (PARTITION BY category ORDER BY path) - 1) // 12 AS batch FROM docs QUALIFY count(*) OVER (PARTITION BY category) >= 2) GROUP BY category, batch"))
def contradiction_prompts(spark, sf_dir):
    d = knowledge_files(spark, sf_dir)
    return P.contradiction_prompts(d, M.scan_batches(d), _HEAD)


@register("expertise_prompt", with_sql("docs", f"SELECT '{_HEAD}' || chr(10) || chr(10) || string_agg({_sql_entry(300)}, '' ORDER BY path) || 'Generated: {AS_OF}' || chr(10) AS prompt FROM (SELECT path, content FROM docs WHERE path <> 'expertise/map.md' ORDER BY path LIMIT 60)"))
def expertise_prompt(spark, sf_dir):
    return P.expertise_prompt(P.expertise_files(knowledge_files(spark, sf_dir)), _HEAD, AS_OF)


@register("system_prompt", with_sql("docs", f"SELECT '{_HEAD}' || chr(10) || '## Mirror' || chr(10) || chr(10) || string_agg(CASE WHEN category = 'style' THEN {_BARE.format('content')} || chr(10) || chr(10) ELSE '### ' || path || chr(10) || {_BARE.format('content')} || chr(10) || chr(10) END, '' ORDER BY category <> 'style', path) AS prompt FROM (SELECT * FROM docs WHERE category IN ('style', 'identity') ORDER BY path DESC LIMIT 5 OFFSET 0) x"))
def system_prompt(spark, sf_dir):
    """With the last five files of two categories, as retrieval gives five."""
    d = knowledge_files(spark, sf_dir).filter(F.split("path", "/")[0].isin("style", "identity"))
    return P.system_prompt(d.orderBy(F.desc("path")).limit(5), _HEAD, "Mirror")


def _sql_talk(files: str) -> str:
    form = P.LEARNING_FORM.replace("'", "''")
    known = f"(SELECT 'Known already:' || chr(10) || string_agg({_sql_entry(300)}, '' ORDER BY path) FROM ({files})) || " if files else ""
    return f"SELECT conv_id, '{_HEAD}' || chr(10) || chr(10) || {known}'Conversation:' || chr(10) || string_agg(role || ': ' || text || chr(10), '' ORDER BY turn) || chr(10) || '{form}' AS prompt FROM conversations GROUP BY conv_id"


def _talks(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")


@register("learning_prompts", with_sql("docs", _sql_talk("SELECT path, content FROM docs WHERE category = 'opinions' ORDER BY path LIMIT 5")))
def learning_prompts(spark, sf_dir):
    files = knowledge_files(spark, sf_dir).filter(F.col("path").startswith("opinions/")).orderBy("path").limit(5)
    return P.conversation_prompts(_talks(spark, sf_dir), _HEAD, files, key="conv_id", order="turn")


@register("reflect_prompts", _sql_talk(""))
def reflect_prompts(spark, sf_dir):
    return P.conversation_prompts(_talks(spark, sf_dir), _HEAD, key="conv_id", order="turn")


@register("scan_batches", with_sql("docs", "SELECT category, (row_number() OVER (PARTITION BY category ORDER BY path) - 1) // 12 AS batch, path FROM docs QUALIFY count(*) OVER (PARTITION BY category) >= 2"))
def scan_batches(spark, sf_dir):
    return M.scan_batches(knowledge_files(spark, sf_dir))


@register("sync_status", with_sql("docs", "SELECT path, CASE WHEN doc_id % 11 = 3 THEN 'remote_only' WHEN doc_id % 10 = 1 THEN 'modified' ELSE 'same' END AS status FROM docs UNION ALL SELECT 'tasks/gone-' || doc_id || '.md', 'local_only' FROM docs WHERE doc_id % 13 = 0"))
def sync_status(spark, sf_dir):
    d = knowledge_files(spark, sf_dir)
    m = lambda x: x.select("path", T.content_hash(F.col("content")).alias("hash"))
    return Y.sync_status(m(_earlier(d)), m(d))


# ---- new versions of the corpus ----

#: Of ten files one is merged into the first, one consolidated into it, and two are moved.
_RANKED = "CASE {} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


@register("apply_plan", with_sql("docs", f"""
SELECT t.path, array_to_string(list_filter(tags_all, lambda x, i: list_position(tags_all, x) = i), ',') AS tags,
  CASE WHEN best > {_RANKED.format('confidence')} THEN ['low', 'medium', 'high'][best] ELSE confidence END AS confidence,
  CASE WHEN body IS NULL THEN updated ELSE DATE '{AS_OF}' END::VARCHAR AS updated,
  md5(CASE WHEN body IS NULL THEN content ELSE regexp_replace(content, '\\n+$', '') || body || chr(10) END) AS content_md5
FROM (SELECT d.*, list_concat(tags, coalesce(more, [])) AS tags_all, best, body FROM docs d LEFT JOIN got ON doc_id = target) t WHERE doc_id % 10 NOT IN (3, 4, 5, 6)
UNION ALL SELECT 'knowledge/moved/' || doc_id || '.md', array_to_string(tags, ','), confidence, updated::VARCHAR, md5(content) FROM docs WHERE doc_id % 10 IN (5, 6)""", {
    "src": f"SELECT *, doc_id - doc_id % 10 AS target, chr(10) || chr(10) || CASE doc_id % 10 WHEN 3 THEN '---' ELSE '## Doc ' || doc_id END || chr(10) || chr(10) || {_BARE.format('content')} AS part FROM docs WHERE doc_id % 10 IN (3, 4)",
    "got": f"SELECT target, string_agg(part, '' ORDER BY path) AS body, max({_RANKED.format('confidence')}) AS best, flatten(list(tags ORDER BY path)) AS more FROM src GROUP BY target",
}))
def apply_plan(spark, sf_dir):
    d = knowledge_files(spark, sf_dir)
    n = F.regexp_extract("path", r"doc-(\d+)\.md$", 1).cast("long")
    numbered = d.select("path", n.alias("n"))
    acts = numbered.filter("n % 10 IN (3, 4, 5, 6)").withColumn("t", F.expr("n - n % 10"))
    targets = numbered.select(F.col("n").alias("t"), F.col("path").alias("into"))
    kind = F.when(F.col("n") % 10 == 3, "merge").when(F.col("n") % 10 == 4, "consolidate").otherwise("move")
    to = F.when(kind == "move", F.concat(F.lit("knowledge/moved/"), F.col("n").cast("string"), F.lit(".md"))).otherwise(F.coalesce("into", F.lit("none")))
    plan = acts.join(targets, "t", "left").select(kind.alias("type"), F.col("path").alias("source_path"), to.alias("target_path"))
    x = M.apply_plan(d, plan, as_of())
    return x.select("path", F.array_join("tags", ",").alias("tags"), "confidence", F.col("updated").cast("string").alias("updated"), F.md5("content").alias("content_md5"))


@register("write_files", with_sql("docs", f"""
SELECT path, array_to_string(tags, ',') AS tags, confidence, source, updated::VARCHAR AS updated, md5(content) AS content_md5 FROM docs WHERE doc_id % 5 <> 0
UNION ALL SELECT CASE WHEN doc_id % 5 = 0 THEN path ELSE 'goals/new-' || doc_id || '.md' END, 'a,b c', CASE WHEN doc_id % 2 = 0 THEN 'high' ELSE 'medium' END, 'tool', '{AS_OF}', md5(chr(10) || source || chr(10)) FROM docs WHERE doc_id % 5 IN (0, 1)
"""))
def write_files(spark, sf_dir):
    """Every fifth file is written anew, as many are added, and as many writes have no valid category."""
    d = knowledge_files(spark, sf_dir)
    n = F.regexp_extract("path", r"doc-(\d+)\.md$", 1).cast("long")
    path = F.when(n % 5 == 0, F.regexp_replace("path", r"\.md$", "")).when(n % 5 == 1, F.concat(F.lit("goals/new-"), n.cast("string"))).when(n % 5 == 2, F.concat(F.lit("misc/"), n.cast("string")))
    writes = d.select(path.alias("path"), F.col("source").alias("content"), F.lit(" a,,b c ").alias("tags"), F.when(n % 2 == 0, "high").otherwise("").alias("confidence")).filter("path IS NOT NULL")
    x = M.write_files(d, writes, as_of())
    return x.select("path", F.array_join("tags", ",").alias("tags"), "confidence", "source", F.col("updated").cast("string").alias("updated"), F.md5("content").alias("content_md5"))


@register("read_file", with_sql("docs", f"SELECT path, array_to_string(tags, ',') AS tags, confidence, {_BARE.format('content')} AS content FROM docs WHERE doc_id = 17"))
def read_file(spark, sf_dir):
    d = knowledge_files(spark, sf_dir)
    path = d.filter(F.col("path").endswith("/doc-17.md")).select("path").first()[0]
    return Y.read_file(d, path).withColumn("tags", F.array_join("tags", ","))


@register("chunk_labels", with_sql("docs chunks", r"SELECT path || '#' || chunk_id AS key, path, split_part(path, '/', 1) AS category, regexp_replace(split_part(path, '/', -1), '\.md$', '') || ' #' || chunk_id AS label, path NOT LIKE 'style/%' AS synced FROM chunks"))
def chunk_labels(spark, sf_dir):
    """Keys of chunks taken apart; files of one category stand for the trash."""
    key = I.chunk_table(knowledge_files(spark, sf_dir)).select(F.concat("path", F.lit("#"), F.col("chunk_id").cast("string")).alias("key"))
    x = key.withColumn("path", T.chunk_key_path(F.col("key")))
    trash = F.regexp_replace("path", "^style/", ".trash/")
    return x.select("key", "path", T.first_segment(F.col("path")).alias("category"), T.chunk_key_label(F.col("key")).alias("label"), (~T.skipped_in_sync(trash)).alias("synced"))
