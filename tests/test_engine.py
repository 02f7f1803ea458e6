import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexispark import schema as S
from lexispark.operators import index as I
from lexispark.operators import maintenance as M
from lexispark.operators import search as R
from lexispark.operators.components import connected_components
from lexispark.plans import vector_queries as VQ
from lexispark.sources import exports as X
from lexispark.sources import files as Z

DAY = dt.date(2026, 1, 1)


def row(path, content, tags=(), confidence="medium", updated=dt.date(2025, 12, 1), used=0):
    return (path, list(tags), confidence, "test", updated, used, None, content)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [
            row("opinions/golang.md", "Go is preferred for CLI tools and services", ["go", "languages", "backend"], "high"),
            row("opinions/architecture.md", "Monorepos work well for small teams", ["architecture", "microservices", "backend"]),
            row("identity/profile.md", "A developer with some background", ["identity", "background"], "high"),
            row("knowledge/long.md", "filler " * 450 + "golang", ["tools"]),
        ],
        S.DOCS,
    )


def test_search(spark, docs):
    x = I.build_index(docs)
    assert {r["tag"]: r["n"] for r in I.tag_index(docs).groupBy("tag").agg(F.count("*").alias("n")).collect()}["backend"] == 2
    top = lambda q: R.ordered(R.bm25_docs(x, R.T.query_terms(q)), "path").first()["path"]
    assert top("CLI tools") == "opinions/golang.md" and top("monorepos") == "opinions/architecture.md"
    assert R.bm25_chunks(x, []).count() == 0
    assert R.bm25_chunks(x, ["long"]).count() == 3  # a path posting reaches every chunk
    assert R.ordered(R.tag_query(docs, ["go", "backend"]), "path").first()["path"] == "opinions/golang.md"
    got = R.retrieve(x, "CLI tools", F.lit(DAY)).collect()
    assert got[0]["path"] == S.PROFILE and got[1]["path"] == "opinions/golang.md"
    assert [r["path"] for r in R.retrieve(x, "nonsense zzz", F.lit(DAY)).collect()] == [S.PROFILE]


def test_increment_equals_rebuild(spark, docs):
    new = docs.filter("path <> 'opinions/golang.md'").withColumn("content", F.when(F.col("path") == "knowledge/long.md", "short now").otherwise(F.col("content")))
    m = lambda d: I.manifest(d, I.chunk_table(d))
    diff = I.manifest_diff(m(docs), m(new))
    assert {r["path"]: r["state"] for r in diff.collect()} == {"opinions/golang.md": "deleted", "knowledge/long.md": "dirty", "identity/profile.md": "unchanged", "opinions/architecture.md": "unchanged"}
    a, b = I.delta_index(I.build_index(docs), new, diff), I.build_index(new)
    for name in ("postings", "chunks", "stats"):
        assert sorted(map(str, getattr(a, name).collect())) == sorted(map(str, getattr(b, name).select(getattr(a, name).columns).collect()))
    assert I.rebuild_is_cheaper(1, 1, 3, True) and not I.rebuild_is_cheaper(1, 1, 4, True) and I.rebuild_is_cheaper(0, 0, 4, False)


def test_fusion(spark):
    a = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "k string, score double")
    b = spark.createDataFrame([("y", 9.0), ("z", 1.0)], "k string, score double")
    got = {r["k"]: r["score"] for r in R.fuse(a, b, keys=["k"]).collect()}
    assert got == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 61, "z": 1 / 62})


def test_relevance_order(spark):
    rows = [("a", 1.0, dt.date(2026, 1, 1), 0, "low"), ("b", 1.0, dt.date(2025, 1, 1), 0, "low"), ("c", 1.0, dt.date(2025, 1, 1), 100, "low"), ("d", 1.0, dt.date(2025, 1, 1), 0, "high"), ("e", 0.0, None, 5, "high")]
    x = spark.createDataFrame(rows, "k string, s double, u date, n int, c string").select("k", R.relevance(F.col("s"), F.col("u"), F.col("n"), F.col("c"), F.lit(DAY)).alias("r"))
    r = {i["k"]: i["r"] for i in x.collect()}
    assert r["a"] > r["b"] and r["c"] > r["b"] and r["d"] > r["b"] and r["e"] == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (5, 5)], "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    chain = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert connected_components(chain).select("component").distinct().collect() == [(0,)]
    assert connected_components(links.limit(0)).count() == 0


def test_decay_boundaries(spark):
    days = lambda n: dt.date(2026, 1, 1) - dt.timedelta(n)
    d = spark.createDataFrame([row("a", "", (), "high", days(179)), row("b", "", (), "high", days(180)), row("c", "", (), "medium", days(364)), row("d", "", (), "medium", days(365)), row("e", "", (), "low", days(999)), row("f", "", (), "high", None)], S.DOCS)
    assert {r["path"]: r["new_confidence"] for r in M.decay_report(d, F.lit(DAY)).collect()} == {"b": "medium", "d": "low"}


def test_learn(spark, docs):
    kind = "seq int, category string, topic string, tags array<string>, content string, confidence string, action string"
    news = [
        (1, "opinions", "golang", ["new"], "Added line", "low", "append"), (2, "opinions", "golang", [], " added LINE", "low", "append"), (3, "style", "tabs", ["t"], "Use tabs", "high", "append"),
        (4, "opinions", "architecture", [], "Replaced", "low", "replace"), (5, "nowhere", "x", [], "x", "low", "create"), (6, "style", "tabs", [], "x", "low", "forget"),
    ]
    out = {r["path"]: r for r in M.learn(docs, spark.createDataFrame(news, kind), "2026-01-01").collect()}
    assert len(out) == 5 and out["style/tabs.md"]["content"] == "\nUse tabs\n" and out["opinions/architecture.md"]["content"] == "\nReplaced\n"
    assert out["opinions/golang.md"]["content"].endswith("services\n\nAdded line\n") and out["opinions/golang.md"]["tags"] == ["go", "languages", "backend", "new"]


def test_plans(spark):
    same = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    d = spark.createDataFrame([row("style/a.md", same, used=1), row("style/b.md", same + " lambda", used=5), row("goals/c.md", "quite other words here"), row("x/note-why.md", "reason because"), row("decisions/note-why.md", "z")], S.DOCS)
    x = I.build_index(d)
    plan = M.duplicate_plan(x).collect()
    assert [(r["source_path"], r["target_path"]) for r in plan] == [("style/a.md", "style/b.md")] and plan[0]["similarity"] > 0.7
    got = M.migrate_plan(d).collect()
    assert [(r["source_path"], r["type"], r["target_path"], r["confidence"]) for r in got] == [("x/note-why.md", "consolidate", "decisions/note-why.md", 1.0)]
    after = {r["path"]: r["content"] for r in M.apply_plan(d, M.duplicate_plan(x), F.lit(DAY)).collect()}
    assert set(after) == {"style/b.md", "goals/c.md", "x/note-why.md", "decisions/note-why.md"} and after["style/b.md"] == f"{same} lambda\n\n---\n\n{same}\n"


def folded(rows):
    """Actions one after the other, as a person would read them."""
    rank, taken, out = {"merge": 0, "consolidate": 1, "move": 2}, set(), []
    actions = {}
    for kind, source, target in rows:
        actions.setdefault((rank[kind], target, source if kind == "move" else "", kind), set()).add(source)
    for (_, target, _, kind), sources in sorted(actions.items(), key=lambda a: (a[0][:2], min(a[1]), a[0][2])):
        if target not in taken and taken.isdisjoint(sources):
            taken |= sources
            out.append((kind, sources, target))
    return sorted((k, kind, s, target) for k, (kind, sources, target) in enumerate(out) for s in sources)


def test_combined_plans_equal_the_fold(spark):
    rng, kind = random.Random(9), "type string, source_path string, target_path string"
    chain = [("move", f"p{k:02d}", f"p{k + 1:02d}") for k in range(6)]
    plans = [[("move", "s", "u"), ("merge", "s", "t"), ("consolidate", "q", "s")], chain, []]
    for files in (6, 12, 40):
        plans.append([(rng.choice(M.PRIORITY), f"f{rng.randrange(files)}", f"f{rng.randrange(files)}") for _ in range(40)])
    plans.append([("merge", f"hot{k}", "target") for k in range(500)] + [("move", f"hot{k}", f"x/hot{k}") for k in range(500)] + [("move", "target", "y")])
    for rows in plans:
        got = M.combine_plans(spark.createDataFrame([*rows, (None, None, "x")], kind)).collect()
        assert sorted(map(tuple, got)) == folded(set(rows))


def test_recategorize_boundary(spark):
    d = spark.createDataFrame([row("style/a.md", "why why"), row("style/b.md", "why"), row("tasks/c.md", "why why why")], S.DOCS)
    assert [r["path"] for r in M.recategorize_plan(d).collect()] == ["style/a.md"]


def test_markdown_files(spark, tmp_path):
    body = "---\ntags: [go, languages]\nconfidence: high\nsource: conversation\nupdated: 2026-03-25\n---\n\nbody text\n"
    (tmp_path / "opinions").mkdir()
    (tmp_path / ".trash").mkdir()
    (tmp_path / "opinions" / "a.md").write_text(body)
    (tmp_path / ".trash" / "b.md").write_text(body)
    d = Z.read_markdown(spark, str(tmp_path))
    r = d.first()
    assert d.count() == 1 and r["path"] == "opinions/a.md" and r["tags"] == ["go", "languages"] and r["updated"] == dt.date(2026, 3, 25) and r["content"] == "\nbody text\n"
    Z.write_markdown(d, str(tmp_path / "out"))
    assert (tmp_path / "out/opinions/a.md").read_text() == body
    (tmp_path / "t.csv").write_text("h,k\n1,2\n")
    got = Z.import_files(spark, str(tmp_path / "*.csv"), "knowledge", "2026-01-01").first()
    assert got["path"] == "knowledge/t.md" and got["content"] == "| h | k |\n| --- | --- |\n| 1 | 2 |\n" and got["source"] == "imported:t.csv"


def test_exports(spark):
    flat = '[{"uuid":"1","name":"n","chat_messages":[{"sender":"human","text":"q"},{"sender":"assistant","text":""},{"sender":"x","text":"a"}]},{"uuid":"2","name":"e","chat_messages":[]}]'
    got = [(r["id"], [tuple(m) for m in r["messages"]]) for r in X.flat_export(spark.createDataFrame([(flat,)], "value string")).collect()]
    assert got == [("1", [("user", "q"), ("assistant", "a")]), ("2", [])]
    tree = '[{"id":"1","title":"t","mapping":{"r":{"parent":null,"children":["s"]},"s":{"parent":"r","children":["u"],"message":{"author":{"role":"system"},"content":{"parts":["x"]}}},"u":{"parent":"s","children":["a","b"],"message":{"author":{"role":"user"},"content":{"parts":["q",{"img":1}," r "]}}},"a":{"parent":"u","children":["r"],"message":{"author":{"role":"assistant"},"content":{"parts":["yes"]}}},"b":{"parent":"u","children":[]}}}]'
    got = X.tree_export(spark.createDataFrame([(tree,)], "value string")).first()
    assert [tuple(m) for m in got["messages"]] == [("user", "q r"), ("assistant", "yes")]
    with pytest.raises(Exception):  # noqa: B017
        X.flat_export(spark.createDataFrame([("{oops",)], "value string")).collect()


def test_stream_learn_takes_all_files(spark):
    """The stream ends with the corpus that learn() makes of all files and all learnings at once."""
    sf = "/root/testdata/sf0.001"
    docs = VQ.knowledge_files(spark, sf)
    batch = M.learn(docs, VQ.learnings_of(docs), "2026-01-01").select("path", F.array_join("tags", ",").alias("tags"), F.octet_length("content").alias("bytes"))
    got = sorted(map(tuple, VQ.stream_learn(spark, sf).collect()))
    assert got == sorted(map(tuple, batch.collect())) and len(got) == docs.count() and all(r[1].endswith(",new") for r in got)


def test_words_of_a_path_are_counted_without_a_shuffle_of_words(spark, docs):
    """Only texts are dealt, by path; each word's row was before. Counts by document are those of all its chunks."""
    chunked = I.content_postings(I.chunk_table(I.by_path(docs)))
    plan = chunked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(path#" in plan
    by_document = chunked.groupBy("term", "path").agg(F.sum("frequency").alias("frequency"))
    assert sorted(map(tuple, I.document_terms(docs).collect())) == sorted(map(tuple, by_document.collect()))


def test_publish_computes_its_files_once(spark, tmp_path):
    """What the files come from, as learnings, ran anew for each table of the index."""
    from lexispark.streaming.corpus import Corpus

    met = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        met.add(1)
        return text

    d = spark.createDataFrame([row(f"style/{k}.md", f"alpha beta w{k}") for k in range(10)], S.DOCS).withColumn("content", seen("content"))
    corpus = Corpus(spark, str(tmp_path / "c"))
    corpus.publish(d)
    assert 10 <= met.value <= 20 and corpus.current().documents.count() == 10
    assert {(r["path"], r["chunks"]) for r in corpus.manifest(1).collect()} == {(f"style/{k}.md", 1) for k in range(10)}


def test_learn_once_for_a_file(spark):
    """A file's only learning is no fold in Python, which failed on a file without text; both ways agree."""
    d = spark.createDataFrame([row(f"style/{n}.md", text, tags=("t",)) for n, text in {"none": None, "same": "Has THE\tlines\n", "more": "x\n\n", "made": "y", "still": "z"}.items()], S.DOCS)
    kind = "seq int, category string, topic string, tags array<string>, content string, confidence string, action string"
    news = [(1, "style", "none", ["t", "u"], "One", "low", "append"), (2, "style", "same", ["u"], "　 has the\tLINES ", "low", "append"), (3, "style", "more", None, None, "low", "append"), (4, "style", "made", ["v"], "New\n", "high", "create"), (5, "goals", "fresh", [], "F", "low", "append")]
    out = {r["path"]: (r["content"], r["tags"], r["confidence"], r["source"]) for r in M.learn(d, spark.createDataFrame(news, kind), "2026-01-01").collect()}
    was = {r["path"]: (r["content"], r["tags"], r["confidence"], r["source"]) for r in d.collect()}
    assert out.pop("style/none.md")[:2] == ("\n\nOne\n", ["t", "u"]) and out.pop("style/more.md")[:2] == ("x\n\n\n", ["t"])
    assert out.pop("style/made.md") == ("\nNew\n\n", ["v"], "high", "conversation") and out.pop("goals/fresh.md") == ("\nF\n", [], "low", "conversation")
    assert out == {p: was[p] for p in ("style/same.md", "style/still.md")}
    twice = spark.createDataFrame([*news[1:], (6, "style", "still", [], "a", "low", "append"), (7, "style", "still", [], " A", "low", "append")], kind)
    assert {r["path"]: r["content"] for r in M.learn(d, twice, "2026-01-01").collect()}["style/still.md"] == "z\n\na\n"
