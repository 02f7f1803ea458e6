"""The driver's documents as a corpus of knowledge files, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark import schema as S
from lexispark.functions import text as T
from lexispark.runtime import read_table

AS_OF = "2026-01-01"
#: The text query of the queries below.
QUERY = "thing reer onha the nding erthing thing"


def as_of():
    return F.lit(AS_OF).cast("date")


def knowledge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a document: category by id, tags language and source, confidence by label, dates and use by id."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    n = F.col("doc_id")
    category = F.element_at(F.array(*map(F.lit, S.CATEGORIES)), (n % 9 + 1).cast("int"))
    return d.join(labels, "doc_id", "left").select(
        F.concat_ws("/", category, "source", F.concat(F.lit("doc-"), n.cast("string"), F.lit(".md"))).alias("path"), F.array("lang", "source").alias("tags"),
        F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium").alias("confidence"), F.col("source"),
        F.date_add(F.lit("2024-01-01").cast("date"), (n * 37 % 730).cast("int")).alias("updated"), (n % 11).cast("int").alias("access_count"), F.lit(None).cast("date").alias("last_accessed"), F.col("text").alias("content"),
    )


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_STEM = "CASE " + " ".join(f"WHEN strlen(t) >= {len(s) + 3} AND ends_with(t, '{s}') THEN t[:length(t) - {len(s)}]" for s in T.SUFFIXES) + " ELSE t END"


def sql_tokens(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array(lower({x}), '\s+'), lambda t: regexp_replace(t, '^[^\p{{L}}\p{{Nd}}]+|[^\p{{L}}\p{{Nd}}]+$', '', 'g')), lambda t: t <> '')"


def sql_stem(x: str) -> str:
    return _STEM.replace("(t,", f"({x},").replace("(t)", f"({x})").replace("THEN t[", f"THEN {x}[").replace("ELSE t ", f"ELSE {x} ")


#: Common table expressions for DuckDB; each list ends with its own name, so `with_sql` can stop there.
CTES = {
    "docs": f"""SELECT doc_id, ({_list(S.CATEGORIES)})[doc_id % 9 + 1] || '/' || source || '/doc-' || doc_id || '.md' AS path,
      ({_list(S.CATEGORIES)})[doc_id % 9 + 1] AS category, [lang, source] AS tags, CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'medium' END AS confidence, source,
      DATE '2024-01-01' + (doc_id * 37 % 730)::INT AS updated, (doc_id % 11)::INT AS access_count, text AS content
      FROM documents LEFT JOIN labels USING (doc_id)""",
    "cut": r"""SELECT path, list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '') AS ws FROM docs""",
    "chunk": """SELECT path, c::INT AS chunk_id, ws[c * 200 + 1 : c * 200 + 200] AS ws FROM cut, unnest(range(greatest(1, (len(ws) + 199) // 200))) u(c)""",
    "toks": f"""SELECT path, chunk_id, {sql_tokens("array_to_string(ws, ' ')")} AS ts FROM chunk""",
    "chunks": """SELECT path, chunk_id, len(ts) AS word_count FROM toks""",
    "words": f"""SELECT path, chunk_id, {sql_stem('w')} AS term FROM (SELECT path, chunk_id, unnest(ts) AS w FROM toks)""",
    "content_p": """SELECT term, path, 'content' AS field, chunk_id, count(*) AS frequency FROM words GROUP BY ALL""",
    "tag_p": f"""SELECT {sql_stem('w')} AS term, path, 'tag' AS field, NULL::INT AS chunk_id, count(*) AS frequency FROM (SELECT path, unnest({sql_tokens('g')}) AS w FROM (SELECT path, unnest(tags) AS g FROM docs)) GROUP BY ALL""",
    "path_p": rf"""SELECT {sql_stem('w')} AS term, path, 'path' AS field, NULL::INT AS chunk_id, count(*) AS frequency FROM (SELECT path, unnest({sql_tokens('g')}) AS w FROM (SELECT path, unnest(string_split(regexp_replace(path, '\.md$', ''), '/')) AS g FROM docs)) GROUP BY ALL""",
    "postings": """SELECT * FROM content_p UNION ALL SELECT * FROM tag_p UNION ALL SELECT * FROM path_p""",
    "sized": """SELECT path, sum(word_count) AS word_count, count(*) AS chunk_count FROM chunks GROUP BY path""",
    "stats": """SELECT count(*) AS n_docs, sum(chunk_count) AS n_chunks, avg(word_count) AS avg_doc, sum(word_count) / sum(chunk_count) AS avg_chunk FROM sized""",
}
_NEEDS = {"cut": ["docs"], "chunk": ["cut"], "toks": ["chunk"], "chunks": ["toks"], "words": ["toks"], "content_p": ["words"], "tag_p": ["docs"], "path_p": ["docs"], "postings": ["content_p", "tag_p", "path_p"], "sized": ["chunks"], "stats": ["sized"]}


def with_sql(names: str, query: str, more: dict[str, str] | None = None) -> str:
    """`query` after the named expressions, those they need, and some of its own."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, ()):
            need(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in (more or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + query


def sql_bm25(terms: str, name: str) -> dict[str, str]:
    """Expressions that score chunks for a table (term, m)."""
    sat = "frequency * 2.5 / (frequency + 1.5 * (0.5 + 0.5 * {} / avg_chunk))"
    return {
        f"{name}_hit": f"SELECT p.*, m FROM postings p JOIN {terms} USING (term)",
        f"{name}_idf": f"SELECT term, ln((any_value(n_docs) - count(DISTINCT path) + 0.5) / (count(DISTINCT path) + 0.5) + 1) AS idf FROM {name}_hit, stats GROUP BY term",
        name: f"""SELECT path, chunk_id, sum(s) AS score FROM (
          SELECT h.path, h.chunk_id, m * idf * {sat.format('word_count')} AS s FROM {name}_hit h JOIN {name}_idf USING (term) JOIN chunks c ON c.path = h.path AND c.chunk_id = h.chunk_id, stats WHERE field = 'content'
          UNION ALL
          SELECT path, unnest(range(chunk_count))::INT, part FROM (
            SELECT h.path, chunk_count, m * idf * {sat.format('word_count')} * CASE field WHEN 'tag' THEN 3 ELSE 2 END / chunk_count AS part
            FROM {name}_hit h JOIN {name}_idf USING (term) JOIN sized z ON z.path = h.path, stats WHERE field <> 'content')
        ) GROUP BY path, chunk_id""",
    }


def sql_terms(terms: list[str]) -> str:
    return f"SELECT term, count(*) AS m FROM (VALUES {', '.join(f'({chr(39)}{t}{chr(39)})' for t in terms)}) v(term) GROUP BY term"
