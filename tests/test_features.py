import datetime as dt
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark import runtime
from lexispark import schema as S
from lexispark.functions import text as T
from lexispark.operators import index as I
from lexispark.operators import maintenance as M
from lexispark.operators import prompts as P
from lexispark.operators import search as R
from lexispark.operators import summary as Y
from lexispark.operators import vectors as V
from lexispark.sources import files as Z
from lexispark.streaming import corpus as C

DAY = dt.date(2026, 1, 1)


def row(path, content, tags=(), confidence="medium", used=0):
    return (path, list(tags), confidence, "test", dt.date(2025, 12, 1), used, None, content)


def test_apply_plan(spark):
    d = spark.createDataFrame([row("goals/a.md", "\nHead\n\n", ["x"], "low"), row("goals/two-words.md", " second ", ["y", "x"], "high"), row("goals/b.md", "third"), row("tasks/m.md", "m"), row("tasks/lost.md", "kept"), row("tasks/e.md", "")], S.DOCS)
    plan = [("consolidate", "goals/two-words.md", "goals/a.md"), ("merge", "goals/b.md", "goals/a.md"), ("merge", "tasks/e.md", "goals/a.md"), ("move", "tasks/m.md", "style/m.md"), ("merge", "tasks/lost.md", "tasks/none.md")]
    out = {r["path"]: r for r in M.apply_plan(d, spark.createDataFrame(plan, "type string, source_path string, target_path string"), F.lit(DAY)).collect()}
    assert set(out) == {"goals/a.md", "style/m.md", "tasks/lost.md"}
    a = out["goals/a.md"]
    assert a["content"] == "\nHead\n\n---\n\nthird\n\n## Two Words\n\nsecond\n\n---\n\n\n" and a["tags"] == ["x", "y"] and a["confidence"] == "high" and a["updated"] == DAY
    assert M.apply_plan(d, spark.createDataFrame([], "type string, source_path string, target_path string"), F.lit(DAY)).count() == 6


def test_writes_and_reads(spark):
    d = spark.createDataFrame([row("goals/a.md", "old", used=3), row("goals/b.md", " b \n")], S.DOCS)
    writes = spark.createDataFrame([("goals/a", "new", " x, ,y", None), ("tasks/n.md", "n", "", "low"), ("misc/z", "z", "", ""), (None, "q", "", "")], "path string, content string, tags string, confidence string")
    out = {r["path"]: r for r in M.write_files(d, writes, F.lit(DAY)).collect()}
    assert set(out) == {"goals/a.md", "goals/b.md", "tasks/n.md"} and out["goals/a.md"]["content"] == "\nnew\n" and out["goals/a.md"]["tags"] == ["x", "y"] and out["goals/a.md"]["confidence"] == "medium"
    assert {r["path"] for r in M.refused_writes(writes).collect()} == {"misc/z", None}
    assert Y.read_file(d, "goals/b.md").first()["content"] == "b" and Y.read_file(d, "none").count() == 0


def test_tool_search_falls_back_to_tags(spark):
    d = spark.createDataFrame([row("goals/a.md", "first line\nmore", ["+!"]), row("goals/b.md", "other")], S.DOCS)
    x = I.build_index(d)
    assert [(r["path"], r["preview"]) for r in R.tool_search(x, "+!", F.lit(DAY)).collect()] == [("goals/a.md", "first line")]
    assert [r["path"] for r in R.tool_search(x, "other", F.lit(DAY)).collect()] == ["goals/b.md"]
    assert R.tool_search(x, "", F.lit(DAY)).count() == 0


def test_postings_of_terms_equal_the_index(spark):
    d = spark.createDataFrame([row("goals/going-home.md", "Going goes gone. The makers make making; éting"), row("goals/b.md", "making " * 300, ["makers"])], S.DOCS)
    x = I.build_index(d)
    key = lambda rows: sorted(map(str, rows.collect()))
    for terms in (["go", "mak", "mak", "mak e"], ["éting", "home", "gone", "maker"], []):
        assert key(x.postings_of(terms)) == key(x.postings.filter(F.col("term").isin(terms or [""])))


def test_corpus(spark, tmp_path):
    d = spark.createDataFrame([row(f"goals/{k}.md", f"text number {k}") for k in range(5)], S.DOCS)
    c = C.Corpus(spark, str(tmp_path / "c"))
    with pytest.raises(LookupError):
        c.current()
    assert c.ensure(d).documents.count() == 5 and c.versions() == [1] and c.ensure(d) is c.current() and c.versions() == [1]
    asked = []

    def embed(texts):
        asked.append(texts.count())
        return V.external_embeddings(texts, lambda ts: [[float(len(t)), 1.0] for t in ts])

    assert c.update_vectors(embed, 1).count() == 5
    c.publish(d.withColumn("content", F.when(F.col("path") == "goals/1.md", "changed").otherwise(F.col("content"))))
    assert c.versions() == [1, 2] and c.update_vectors(embed, 2).count() == 5 and asked == [5, 1]
    assert C.read_manifest(spark, str(tmp_path / "none")).columns == ["path", "hash", "chunks"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.parquet").write_text("no table")
    assert C.read_manifest(spark, str(tmp_path / "bad")).count() == 0


def test_embedder_that_fails(spark):
    texts = spark.createDataFrame([("a", k, f"t{k}") for k in range(3)], "path string, chunk_id int, text string").coalesce(1)

    def embed(ts):
        if "t1" in ts:
            raise OSError("no answer")
        return [[1.0] for _ in ts]

    assert {r["chunk_id"]: r["vec"] for r in V.external_embeddings(texts, embed, batch=1).collect()} == {0: [1.0], 1: None, 2: [1.0]}


def test_small_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.escape_pipe(F.lit("a|b"))) == "a\\|b"
    assert [one(T.safe_substring(F.lit(" abc def"), F.lit(a), F.lit(b))) for a, b in ((0, 4), (5, 99), (8, 1))] == ["abc", "def", " abc def"]
    assert one(T.chunk_key_label(F.lit("a/b-c.md#3"))) == "b-c #3" and one(T.chunk_key_label(F.lit("x.md"))) == "x" and one(T.chunk_key_path(F.lit("a#b#1"))) == "a#b"
    assert one(T.first_segment(F.lit("a/b"))) == "a" and one(T.first_segment(F.lit("a"))) == "a"
    assert [one(T.skipped_in_sync(F.lit(p))) for p in (".trash/x", ".gitignore", "goals/.gitignore", "trash/x")] == [True, True, False, False]
    assert T.expand_environment("a ${X} ${NONE}b $X ${a-b}", {"X": "1"}) == "a 1 b $X ${a-b}"
    go = "package p\n\ntype (\n\tFirst struct {\n\t\tinner int\n\t}\n\tSecond[T any] = []T\n)\n\ntype Third int\n"
    assert [(s["name"], s["kind"]) for s in one(T.symbols(F.lit(go), "go"))] == [("Third", "type"), ("First", "type"), ("Second", "type")]
    assert [one(T.stem(F.lit(w))) for w in ("nation", "makers", "makings", "ed", "aed", "xyzed", "ability")] == ["nation", "maker", "making", "ed", "aed", "xyz", "ability"]


def test_ranks(spark):
    d = spark.createDataFrame([(k * 7 % 50, "x") for k in range(50)], "n int, s string").repartition(7)
    assert sorted((r["n"], r["rank"]) for r in runtime.ranked(d, "n").collect()) == [(k, k) for k in range(50)]
    assert runtime.ranked(d.limit(0), "n").count() == 0


def test_import_counts_and_flags(spark):
    kind = "id string, messages array<struct<role:string,content:string>>"
    talks = spark.createDataFrame([("a", [("user", "x")]), ("b", []), ("c", [("user", "y")]), ("d", [("user", "z")])], kind)
    done = talks.filter("id = 'c'").select("id", T.conversation_hash(F.col("messages")).alias("hash"))
    assert Y.import_counts(talks, done, spark.createDataFrame([("d",), ("d",)], "id string")).first().asDict() == {"processed": 1, "unchanged": 1, "empty": 1, "failed": 1}
    assert [r["low_confidence"] for r in Y.low_confidence(spark.createDataFrame([(0.39,), (0.4,)], "confidence double")).collect()] == [True, False]


def test_prompts(spark):
    d = spark.createDataFrame([row("style/s.md", " Short. "), row("goals/g.md", "x" * 400), row("expertise/map.md", "map")], S.DOCS)
    got = P.system_prompt(d, "Head", "Mirror").first()["prompt"]
    assert got.startswith("Head\n## Mirror\n\nShort.\n\n### expertise/map.md\nmap\n\n### goals/g.md\n")
    talks = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], "id int, position int, role string, content string")
    got = P.conversation_prompts(talks, "Head", d).first()["prompt"]
    assert "x" * 300 + "...\n" in got and "Conversation:\nuser: a\nassistant: b\n" in got
    assert "Known" not in P.conversation_prompts(talks, "Head", d.limit(0)).first()["prompt"]
    assert {r["path"] for r in P.expertise_files(d).collect()} == {"style/s.md", "goals/g.md"}


def test_xlsx(tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}"><sheets><sheet name="One"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>head</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="A2" t="inlineStr"><is><t>a|b</t></is></c></row></sheetData></worksheet>')
    assert Z.xlsx_table((tmp_path / "t.xlsx").read_bytes()) == "| head |  | 3 |\n| --- | --- | --- |\n| a\\|b |  |  |\n"


@pytest.mark.parametrize("gram", [3000, 0])
def test_lsi_against_numpy(spark, monkeypatch, gram):
    """Both ways of the decomposition give the cosines of chunks that numpy's gives."""
    monkeypatch.setattr(V, "GRAM_DOCS", gram)
    rng = random.Random(1)
    words = [c + d for c in "bcdfg" for d in "aeiou"]
    texts = [" ".join(rng.choice(words[k % 3 * 6 : k % 3 * 6 + 12]) for _ in range(30)) for k in range(9)]
    x = I.build_index(spark.createDataFrame([row(f"goals/{k}.md", t) for k, t in enumerate(texts)], S.DOCS))
    terms = V.lsi_terms(x)
    got = {r["path"]: np.array(r["vec"]) for r in V.chunk_vectors(x, terms).collect()}
    tf = np.array([[t.split().count(w) for t in texts] for w in words], float)
    df = (tf > 0).sum(1)
    tf, df = tf[df >= 2], df[df >= 2]
    idf = np.log(len(texts) / df)
    a = np.log1p(tf) * idf[:, None]
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    u = u[:, s > 1e-6][:, : min(50, len(texts) - 1)]
    want = (np.log1p(tf) * idf[:, None]).T @ u
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    have = np.array([got[f"goals/{k}.md"] for k in range(len(texts))])
    assert np.allclose(have @ have.T, want @ want.T, atol=1e-6)


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=(60, 4))
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(e)], "n long, v array<double>")
    axes = V.principal_axes(d, "n", "v")
    p = {r["id"]: r["p"] for r in axes.collect()}
    order = sorted(p, key=lambda k: (p[k], k))
    unit = e / np.linalg.norm(e, axis=1, keepdims=True)
    near = [(min(a, b), max(a, b), round(float(unit[a] @ unit[b]), 3)) for i, a in enumerate(order) for b in order[i + 1 : i + 11]]
    want = {}
    for a, b, v in sorted((x for x in near if x[2] >= 0.5), key=lambda x: (x[0], -x[2], x[1])):
        want.setdefault(a, []).append((a, b, v))
    got = sorted(map(tuple, V.link_graph(d, axes, "n", "v", width=10).collect()))
    assert got == sorted(x for xs in want.values() for x in xs[:4])
    c = e - e.mean(0)
    first = np.linalg.svd(c, full_matrices=False)[2][0]
    assert np.isclose(abs(np.corrcoef(e @ first, [p[k] for k in range(60)])[0, 1]), 1)
    assert V.principal_axes(d.limit(0), "n", "v").count() == 0
