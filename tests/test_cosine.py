"""All pairs of vectors by blocks against plain Python."""

import math
import random

import pytest

from lexispark.operators import cosine
from lexispark.operators import maintenance as M
from lexispark.plans import catalog


def some_vectors(rng, n):
    docs, families = {}, [rng.sample(range(300), 12) for _ in range(8)]
    for k in range(n):
        terms = set(rng.choice(families)) if k % 3 else set(rng.sample(range(300), rng.randint(1, 25)))
        terms ^= set(rng.sample(range(300), rng.randint(0, 4)))
        docs[f"{'xy'[k % 2]}/{k:03d}"] = {f"t{t}": rng.random() + 0.1 for t in terms or {1}}
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    norm = {p: math.sqrt(sum(w * w for w in d.values())) for p, d in docs.items()}
    return {p: {t: w / norm[p] for t, w in d.items()} for p, d in docs.items()}, df


@pytest.mark.parametrize("threshold, grouped, products", [(0.7, False, 50), (0.35, True, 1 << 20)])
def test_pairs_equal_plain_python(spark, monkeypatch, threshold, grouped, products):
    monkeypatch.setattr(cosine, "FEW", 0)
    monkeypatch.setattr(cosine, "PRODUCTS", products)
    docs, df = some_vectors(random.Random(5), 160)
    rows = [(p, t, df[t], w) for p, d in docs.items() for t, w in d.items()]
    vectors = spark.createDataFrame(rows, "path string, term string, n long, w double")
    got = M.cosine_pairs(vectors, threshold, vectors.path.substr(1, 1) if grouped else None).collect()
    want = {(a, b): s for a in docs for b in docs if a < b and (not grouped or a[0] == b[0]) for s in [sum(w * docs[b].get(t, 0) for t, w in docs[a].items())] if s >= threshold - 1e-9}
    assert len(got) == len(want) > 50 and all(abs(want[r["a"], r["b"]] - r["similarity"]) < 1e-9 for r in got)
    assert M.cosine_pairs(vectors.limit(0), threshold).count() == 0


def test_few_pairs_leave_a_task(spark, monkeypatch):
    """Documents that share a rare term each with many others, but aren't alike: their pairs aren't handed on."""
    monkeypatch.setattr(cosine, "FEW", 0)
    w = 1 / math.sqrt(50)
    rows = [(f"d{k:03d}", f"t{t}", 4, w) for k in range(200) for t in (*(f"own{k}-{i}" for i in range(30)), *(f"c{(k * (i + 1)) % 40}-{i}" for i in range(20)))]
    seen = []
    real = cosine.checkpointed

    def kept(df):
        out = real(df)
        if out.columns == ["x", "y"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(cosine, "checkpointed", kept)
    vectors = spark.createDataFrame(rows, "path string, term string, n long, w double")
    assert M.cosine_pairs(vectors, 0.7).count() == seen[0] == 0


def test_copies_follow_their_representative(spark, tmp_path):
    """Files of one text and tags are compared once, and listed as pairs and members all the same."""
    text, other = "alpha beta gamma delta " * 9, "some words that stand in no other file at all"
    docs = [(k, text, "en", "web") for k in range(0, 90, 9)] + [(k, f"{other} {k}a {k}b {k}c {k}d", "de", "book") for k in range(1, 20, 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    pairs = [r for r in catalog.QUERIES["doc_cosine_pairs"](spark, str(tmp_path)).collect() if r["similarity"] == 1.0]
    assert len(pairs) == 45 and all(r["a"] < r["b"] for r in pairs)
    members = [r["cluster"] for r in catalog.QUERIES["dedup_components"](spark, str(tmp_path)).collect()]
    assert members.count(min(r["a"] for r in pairs)) == 10


def test_prefixes_are_written_once_whatever_the_blocks(spark, monkeypatch):
    """Prefixes were shuffled once for each block, of which there are more with the corpus; now a document's lies in one file."""
    monkeypatch.setattr(cosine, "FEW", 0)
    monkeypatch.setattr(cosine, "BLOCKS", 12)
    left = []
    monkeypatch.setattr(cosine.Folder, "remove", lambda self, name: left.append(self.root))
    docs, df = some_vectors(random.Random(6), 60)
    rows = [(p, t, df[t], w) for p, d in docs.items() for t, w in d.items()]
    got = M.cosine_pairs(spark.createDataFrame(rows, "path string, term string, n long, w double"), 0.7).count()
    assert got == sum(sum(w * docs[b].get(t, 0) for t, w in docs[a].items()) >= 0.7 - 1e-9 for a in docs for b in docs if a < b) > 5
    written = spark.read.parquet(left[0])
    assert written.count() == len(docs) and 8 < written.select("block").distinct().count() <= 12


def test_reorg_counts_documents_once(spark, tmp_path, monkeypatch):
    """Both plans on likeness cut and counted all texts, and wrote their vectors, each for itself."""
    spark.createDataFrame([(1, "some words", "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    asked = []

    def rows(docs, group=None):
        asked.append(group is not None)
        return spark.createDataFrame([], "path string, id long, g long, words long, keys array<long>, levels array<int>, ws array<double>")

    monkeypatch.setattr(M, "document_rows", rows)
    monkeypatch.setattr(M, "_alike", lambda *a: (spark.createDataFrame([], "path string, cluster string"), spark.createDataFrame([], "path string, pairs long, total double")))
    monkeypatch.setattr(M, "combine_plans", lambda plan: plan)
    catalog.QUERIES["reorg_combined"](spark, str(tmp_path))
    assert asked == [True]
