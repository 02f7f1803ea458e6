import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lexispark.llm import ngram_join, registry, secrets


def plain_components(rows):
    """By comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyzuvw") + str(rng.randrange(30))
    passage = [word() for _ in range(60)]
    texts = [None, "", "  ", "one two", "ONE two", "one two three four five", "one  two\tthree four FIVE"]
    base = [[word() for _ in range(rng.choice([8, 40, 120]))] for _ in range(40)]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rng.randrange(4)):  # chains of changes, so that ends of a component need no link
            b = [word() if rng.random() < 0.03 else w for w in b]
            texts.append(" ".join(b))
        if rng.random() < 0.5:
            texts.append(" ".join(b[:5] + passage + b[5:]))
    crowd = [word() for _ in range(100)]
    texts += [" ".join(crowd[:k] + ["z"] + crowd[k:]) for k in range(60)]
    texts += [" ".join(passage + [word() for _ in range(25)]) for _ in range(30)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("group", F.lit(1)).repartition(3)
    want = plain_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df).collect()} == want
    kept = ngram_join.keep_one_of_each(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c) and kept.columns == df.columns
    assert ngram_join.ngram_join(df.limit(0)).count() == 0


def test_ngram_join_of_one_large_group(spark):
    """Edits up to and beyond the threshold, shorter and longer cuts of one text, variants within the group; null ids and repeated rows."""
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyzuvw") + str(rng.randrange(3000))
    base = [word() for _ in range(120)]
    variant = base[:50] + [word() for _ in range(9)] + base[59:]
    rows = []
    for _ in range(150):
        w = list(rng.choice([base, base, variant]))
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = word()
        rows.append(w)
    for _ in range(60):
        k = rng.randrange(60, 121)
        rows.append(base[:k] if rng.random() < 0.5 else base + [word() for _ in range(120 - k)])
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rng.shuffle(rows)
    want = plain_components(rows)
    assert len({c for _, c in want.values()}) > 10
    odd = [(None, rows[0][1]), (None, None), (None, "word"), *rows[:5]]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], (r["n_shingles"], r["component_id"])) for r in ngram_join.ngram_join(df).collect()]
    assert len(got) == len(rows) + len(odd)
    assert all(v == want[i] for i, v in got if i is not None) and {i for i, _ in got if i is not None} == set(want)
    assert ngram_join.keep_one_of_each(df).filter("doc_id IS NULL").count() == 3


@pytest.mark.parametrize("seed", [3, 4])
def test_centre_that_lacks_what_its_group_holds(spark, monkeypatch, seed):
    """Documents know a centre that misses passages of most of them; no link is lost, and such a passage is no list."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyzuvw") + str(rng.randrange(3000))
    base, gap, other = [word() for _ in range(100)], [word() for _ in range(12)], [word() for _ in range(14)]
    rows = [base]
    for k in range(140):
        w = base[:50] + gap + base[50:] if k % 5 else base[:30] + other + base[30:]
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = word()
        rows.append(w + [word() for _ in range(rng.choice([0, 0, 10, 30, 45]))])
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    want = plain_components(rows)
    assert len({c for _, c in want.values()}) > 10
    lists, widened = [], ngram_join.widened

    def watched(known):
        out = widened(known).cache()
        total = lambda x: x.agg(F.sum("o"), F.sum(F.col("o") + F.size("rest"))).first()
        most = lambda x: x.select("ref", F.explode("rest").alias("s")).groupBy("ref", "s").count().agg(F.max("count")).first()[0]
        lists.append((total(known), total(out), most(known), most(out), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "widened", watched)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df).collect()} == want
    (before, after, long_before, long_after, n), = lists
    assert before[1] == after[1] and before[0] <= after[0] and long_after <= max(long_before, 0) and n > 0


def test_widened_references(spark, monkeypatch):
    """What over half of a reference's documents hold counts as the reference's; documents without a rest stay."""
    monkeypatch.setattr(ngram_join, "HOT", 2)
    rows = [(1, 1, 9, 20, 20, []), (2, 2, 9, 20, 17, [1, 2, 3]), (3, 3, 9, 19, 17, [1, 2]), (4, 4, 9, 21, 18, [1, 5, 6]), (5, 5, 8, 10, 8, [1, 7]), (6, 6, None, 5, 4, [1])]
    known = spark.createDataFrame(rows, "id long, group long, ref long, size long, o long, rest array<long>")
    got = {r["id"]: (r["o"], sorted(r["rest"])) for r in ngram_join.widened(known).collect()}
    assert got == {1: (20, []), 2: (18, [2, 3]), 3: (18, [2]), 4: (19, [5, 6]), 5: (8, [1, 7]), 6: (4, [1])}
    assert ngram_join.widened(known.limit(0)).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        docs = docs.cache()
        if name == "packing":
            break
        assert docs.columns == before.columns
        was, now = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (before, docs))
        assert set(now) <= set(was)
        if name == "exact_copies":
            last = {}
            for i, t in was.items():
                k = "".join(c.lower() if c.isascii() else c for c in t)
                last[k] = max(i, last.get(k, i))
            assert set(now) == set(last.values())
        if name == "near_copies":
            assert set(now) == {i for i, (_, c) in plain_components(was.items()).items() if i == c}
        if name == "secrets":
            assert set(now) == set(was) and not any(r["secret_base"] for r in secrets.find_secrets(docs).collect())
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(was) and set(was) <= set(rows)


def test_registry():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in registry.queries()} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_pipeline_gives_token_ids(spark):
    docs = spark.createDataFrame([(1, "one text"), (2, "another, longer text of words"), (3, None)], "doc_id long, text string")
    got = corpus_pipeline.packing(spark, docs, "").collect()
    assert len(got) == 3 and all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got)
