"""Decontamination, resampling and collocations against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.llm import collocations, decontamination, resampling, tokens

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low(text))]


def some_texts(rng, n, alphabet, most):
    return [None if rng.random() < 0.05 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_split_words_on_any_text():
    rng = random.Random(3)
    for _ in range(200):
        texts = some_texts(rng, rng.randint(0, 8), "aB1.,; \t\n\r\x0b\x0cñ漢_!\x00\x1fZ", 12)
        at = rng.randint(0, len(texts))
        column, rest = pa.array(texts, pa.string()).slice(at), texts[at:]
        for kinds, want in ((tokens.ALNUM, [ALNUM.findall(low(t)) for t in rest]), (tokens.PHRASE, [[w for p in pieces(t) for w in p] for t in rest])):
            w = tokens.split_words(column, kinds)
            names = [b.decode() for b in w.vocabulary.to_pylist()]
            assert [[names[c] for c, t in zip(w.code, w.text) if t == k] for k in range(len(rest))] == want
            assert len(set(w.hashes().tolist())) == len(names)
        assert list(w.begins) == [k == 0 for t in rest for p in pieces(t) for k, _ in enumerate(p)]


def test_bitmap_holds_what_it_was_given(spark):
    x = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000)
    packed = tokens.bitmap(spark.createDataFrame([(int(v),) for v in x[:2500]], "hash long"), "hash", bits=20)
    held = tokens.in_bitmap(packed, x.view(np.uint64))
    assert len(packed) == 1 << 17 and held[:2500].all() and held[2500:].mean() < 0.05
    assert not tokens.in_bitmap(tokens.bitmap(spark.createDataFrame([], "hash long"), "hash", bits=20), x.view(np.uint64)).any()


# ---- decontamination ----


def decontaminated(docs, items, window=10):
    split = {}
    for item, text in items:
        w = ALNUM.findall(low(text))
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            split.setdefault(tuple(w[k : k + size]), set()).add(item)
    sizes, out = {len(s) for s in split}, []
    for doc, text in docs:
        w, hit, found = ALNUM.findall(low(text)), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in split:
                    hit.update(range(k, k + size))
                    found |= split[tuple(w[k : k + size])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def checked(spark, docs, items, kind="doc_id long, text string", **options):
    got = decontamination.decontaminate(spark.createDataFrame(docs, kind), spark.createDataFrame(items, "item_id long, text string"), **options)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got.collect()) == order(decontaminated(docs, items, options.get("window", 10)))
    return got


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    words = "alpha beta gamma delta ñu 漢字 x1 the of".split()
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for k in range(12)]
    items += [(12, None), (13, "..."), (14, items[3][1]), (2, "another text under a known id"), (None, "nobody owns this window of exactly ten words in all")]
    docs = [(k, rng.choice([" ", ", ", "\n-"]).join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for k in range(60)]
    docs += [(100 + k, f"Before it, {t.upper() if t else ''}; and after") for k, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (5, docs[5][1]), (5, "the"), (None, items[4][1]), (300, " ".join([words[0]] * 30_000) + " " + items[8][1])]
    checked(spark, docs, items)
    checked(spark, docs, items, window=4, shingle=2)
    checked(spark, docs, items, window=3, shingle=5)


def test_decontamination_of_empty_tables_and_other_columns(spark):
    docs = [(1, "one two three four five six seven eight nine ten eleven"), (2, "x")]
    assert [r["n_hit"] for r in checked(spark, docs, []).collect()] == [0, 0]
    checked(spark, [], [(1, "one two")])
    more = spark.createDataFrame([(1, "one two", 7, "a")], "doc_id string, text string, n_words int, shingle string")
    got = decontamination.decontaminate(more, spark.createDataFrame([(9, "two")], "item_id int, text string")).first()
    assert got["doc_id"] == "1" and (got["n_words"], got["n_hit"]) == (2, 1)


def test_windows_of_a_passage_in_many_documents(spark):
    """One passage in all documents, and windows broadcast or not, give the same rows."""
    passage = " ".join(f"w{k}" for k in range(25))
    docs = [(k, f"doc{k} {passage} end{k % 7}") for k in range(400)]
    before = decontamination.FEW
    try:
        for decontamination.FEW in (before, 0):
            assert {r["n_hit"] for r in checked(spark, docs, [(1, passage), (2, f"end3 {passage}")]).collect()} == {25}
    finally:
        decontamination.FEW = before


# ---- resampling ----


def sampled(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    def features(text):
        w = [x.encode() for x in ALNUM.findall(low(text))]
        return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    own = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for _, x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for d, n, f in own:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    top = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: percent * len(rows) // 100]
    rank = {id(r): k + 1 for k, r in enumerate(top)}
    return [(*r[:4], rank.get(id(r))) for r in rows]


@pytest.mark.parametrize("options", [{}, {"longest": 3, "buckets": 50}, {"percent": 60, "least_words": 3}, {"buckets": 70_000, "percent": 100}])
def test_resampling_equals_plain_python(spark, options):
    rng = random.Random(8)
    words = "alpha beta gamma delta ñu 漢字 x1 the of and".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)] + [None, "", "...", "the " * 20_000]
    docs = [(k, texts[k % len(texts)]) for k in range(190)] + [(1000 + k, texts[7]) for k in range(60)] + [(None, texts[9])]
    target = [(0, "alpha Beta ñu x1"), (1, None), (2, "alpha " * 9)]
    got = resampling.importance_sample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(target, "item_id long, text string"), **options)
    plain = {("least" if k == "least_words" else k): v for k, v in options.items()}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(sampled(docs, target, **plain), key=repr)


def test_resampling_of_repeated_rows_and_empty_tables(spark):
    kind, text = "doc_id long, text string, rank int, key string", "one two three " * 8
    same = spark.createDataFrame([(4, text, 0, "x")] * 10 + [(5, text, 0, "y")], kind)
    none = spark.createDataFrame([], "text string")
    got = resampling.importance_sample(same, none, percent=30).collect()
    assert len(got) == 11 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3] and len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert resampling.importance_sample(same.limit(0), none).count() == 0
    assert {r["rank"] for r in resampling.importance_sample(same, none, percent=5).collect()} == {None}


def test_resampling_query_draws_a_share_of_documents_with_enough_words(spark, tmp_path):
    """30 documents of 20 words and 30 of fewer give 3 drawn ones, not 6."""
    docs = [(k, f"w{k} " * (20 if k % 2 else 19)) for k in range(60)]
    target = [(0, "w1 w2 w3")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(target, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: tuple(r) for r in resampling.query(spark, str(tmp_path)).collect()}
    all_of_them = sampled(docs, target)  # draws from the same order, 6 of them
    assert got == {r[0]: (*r[:4], r[4] if r[4] and r[4] <= 3 else None) for r in all_of_them}


# ---- collocations ----


def substrings(runs, depth):
    count, ends = Counter(), {}
    at = 0
    for run in runs:
        for i in range(len(run)):
            for n in range(1, min(depth, i + 1) + 1):
                x = tuple(run[i - n + 1 : i + 1])
                count[x] += 1
                ends.setdefault(x, set()).add(at + i)
        at += len(run)
    return count, ends


def test_automaton_states_are_classes_of_end_places():
    rng = random.Random(2)
    for _ in range(60):
        runs = [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(0, 6))]
        code = np.array([c for r in runs for c in r], np.int64)
        begins = np.array([k == 0 for r in runs for k, _ in enumerate(r)], bool)
        x, (count, ends) = collocations.automaton(code, begins, 4), substrings(runs, 4)
        assert {tuple(code[e - n + 1 : e + 1]): c for es, n, cs in x.substrings() for e, c in zip(es, cs)} == count
        assert len(x.end) == len({frozenset(v) for v in ends.values()})
        for k in range(len(x.end)):
            whole = tuple(code[x.end[k] - x.longest[k] + 1 : x.end[k] + 1])
            assert all(ends[whole[-n:]] == ends[whole] for n in range(x.shortest[k], x.longest[k] + 1))
            if x.link[k] >= 0:
                assert x.longest[x.link[k]] == x.shortest[k] - 1 and x.count[x.link[k]] > x.count[k]
            else:
                assert x.shortest[k] == 1


def mined(rows, least=30, longest=4, top=2000, share=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            f.update((lang, tuple(p[i : i + m])) for m in range(1, longest + 1) for i in range(len(p) - m + 1))
    cand = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    gone = {(g, w[i : i + m]) for (g, w), v in cand.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * v >= share * cand[g, w[i : i + m]]}
    out = []
    for lang in n:
        best = []
        for (g, w), a in cand.items():
            if g == lang and (g, w) not in gone:
                score, _, l, r = min((2_000_000 * a // (f[g, w[:k]] + f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
                best.append((-score, -a, " ".join(w).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return out


def test_collocations_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = "New york City the of a ñu 漢字 x-1 \x1f".split(" ")

    def text():
        return "".join(rng.choice(["New York City hall", "the the the", *words]) + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "\r"]) for _ in range(rng.randint(0, 40)))

    rows = [(rng.choice(["en", "en", "de", None, "und", ""]), rng.choice([text(), text(), None, ""])) for _ in range(300)] + [("en", "one long text " * 9000)] * 2
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit("x"))
    for shard in (collocations.SHARD, 3000):  # many small shards give the same
        monkeypatch.setattr(collocations, "SHARD", shard)
        for options in ({}, {"least": 2, "top": 15}, {"least": 5, "longest": 3, "share": 100}, {"least": 1, "longest": 2}):
            got = collocations.collocations(df, **options)
            assert sorted(map(tuple, got.collect())) == sorted(mined(rows, **options))
    assert collocations.collocations(df.limit(0)).count() == 0


def test_collocation_scores_pass_64_bits(spark):
    big = 1 << 61
    got = spark.sql(f"SELECT cast(2000000 as decimal(7,0)) * cast({big}L as decimal(19,0)) div (cast({big}L as decimal(19,0)) + cast({big + 1}L as decimal(19,0))) AS s").first()["s"]
    assert got == 2_000_000 * big // (2 * big + 1)
