"""The segmented index against rebuilds over random versions, writers that die, and what is written."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexispark import schema as S
from lexispark.operators import index as I
from lexispark.operators.segments import Files, SegmentedCorpus

WORDS = "running tools testing golang the of and services small teams".split()


def file(rng, path):
    text = "\n\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 150))) for _ in range(rng.randint(0, 4)))
    return (path, rng.sample(["go", "dev ops", "x"], rng.randint(0, 2)), "high", "t", dt.date(2025, 1, 1), rng.randint(0, 9), None, text)


def frame(spark, files):
    return spark.createDataFrame(list(files), S.DOCS).coalesce(1)


def rows(df, columns=None):
    return sorted(map(repr, map(tuple, df.select(columns or df.columns).collect())))


def same_as_rebuild(corpus, docs):
    got, want = corpus.current(), I.build_index(docs)
    for name in ("docs", "documents", "postings", "stats"):
        assert rows(getattr(got, name)) == rows(getattr(want, name), getattr(got, name).columns), name
    assert rows(got.chunks) == rows(want.chunks, ["path", "chunk_id", "word_count"])
    assert rows(corpus.manifest()) == rows(I.manifest(docs, want.chunks), ["path", "hash", "chunks"])


def test_random_versions_equal_rebuilds(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rng = random.Random(11)
        files = {p: file(rng, p) for p in (f"knowledge/a{k}.md" for k in range(30))}
        corpus = SegmentedCorpus(spark, str(tmp_path / "c"), fanout=3)
        assert corpus.publish(frame(spark, files.values()))["rebuilt"]
        merges = 0
        for step in range(20):
            some = rng.sample(sorted(files), rng.randint(0, min(5, len(files))))
            for p in some[:2]:
                del files[p]
            for p in some[2:] + [f"style/b{step}-{k}.md" for k in range(rng.randint(0, 2))] + rng.choice([[], ["knowledge/a1.md"]]):
                files[p] = file(rng, p)
            if step % 2:
                out = corpus.publish(frame(spark, files.values()))
            else:
                news = [files[p] for p in files if p in some[2:] or p.startswith(f"style/b{step}-") or p == "knowledge/a1.md"]
                out = corpus.apply(frame(spark, news), frame(spark, []).select("path").unionByName(spark.createDataFrame([(p,) for p in [*some[:2], "no/such.md"]], "path string")))
            merges += out.get("merged", 0)
            if step in (8, 19):
                same_as_rebuild(corpus, frame(spark, files.values()))
        assert merges > 3 and len(corpus.version().segments) < 7
        before = corpus.versions()
        corpus.vacuum(keep=2)
        assert corpus.versions() == before[-2:]
        same_as_rebuild(corpus, frame(spark, files.values()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_version_writes_what_changed(spark, tmp_path):
    rng = random.Random(1)
    files = {f"knowledge/{k}.md": file(rng, f"knowledge/{k}.md") for k in range(4000)}
    corpus = SegmentedCorpus(spark, str(tmp_path / "c"), small=1 << 10)
    whole = corpus.publish(frame(spark, files.values()))["bytes"]
    files["knowledge/7.md"] = file(rng, "knowledge/7.md")
    out = corpus.publish(frame(spark, files.values()))
    assert not out["rebuilt"] and out["dirty"] == 1 and out["bytes"] < whole / 20
    assert corpus.current().postings_of(["golang"]).filter("path = 'knowledge/7.md'").count() == I.build_index(frame(spark, [files["knowledge/7.md"]])).postings.filter("term = 'golang'").count()
    held, old = corpus.index(1), corpus.index(2)
    corpus.apply(frame(spark, [file(rng, "knowledge/8.md")]), number=5)
    assert corpus.versions() == [1, 2, 5] and rows(held.docs.filter("path = 'knowledge/7.md'")) != rows(old.docs.filter("path = 'knowledge/7.md'"))
    assert corpus.apply(frame(spark, []), number=5) == {"version": 5, "skipped": True}
    with pytest.raises(ValueError, match="before"):
        corpus.apply(frame(spark, []), number=4)
    with pytest.raises(LookupError):
        corpus.version(3)


def test_writers_that_die_leave_the_last_version(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    files = {f"style/{k}.md": file(rng, f"style/{k}.md") for k in range(12)}
    corpus = SegmentedCorpus(spark, str(tmp_path / "c"))
    with pytest.raises(LookupError):
        corpus.current()
    corpus.publish(frame(spark, files.values()))
    changed = file(rng, "style/3.md")
    after = frame(spark, (files | {"style/3.md": changed}).values())
    for owner, name in ((SegmentedCorpus, "_write_segment"), (SegmentedCorpus, "_merge"), (Files, "commit")):
        with monkeypatch.context() as m:
            m.setattr(owner, name, lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                corpus.publish(after)
        assert corpus.versions() == [1]
        same_as_rebuild(corpus, frame(spark, files.values()))
    real = SegmentedCorpus._write_segment

    def half(self, tables, number, kind):  # dies after two of the tables
        real(self, dict(list(tables.items())[:2]), number, kind)
        raise ZeroDivisionError

    with monkeypatch.context() as m:
        m.setattr(SegmentedCorpus, "_write_segment", half)
        with pytest.raises(ZeroDivisionError):
            corpus.publish(after)
    corpus.publish(after)
    same_as_rebuild(corpus, after)
    left = len(corpus.files.names("segments"))
    corpus.vacuum(keep=5)
    assert len(corpus.files.names("segments")) < left and corpus.versions() == [1, 2]
    other = SegmentedCorpus(spark, str(tmp_path / "c"))
    assert not other.files.commit("versions/v00000002.json", "{}") and other.version().number == 2
    corpus.apply(frame(spark, []), after.select("path"))
    assert corpus.current().docs.count() == 0 and corpus.current().stats.first()["n_docs"] == 0
    assert corpus.current().docs.filter(F.lit(True)).columns == after.columns


def test_postings_come_from_one_pass(spark, tmp_path):
    """Tokens were written with the chunks and postings were shuffled by term; a version's folder now holds no text but the docs."""
    rng = random.Random(3)
    files = [file(rng, f"style/{k}.md") for k in range(20)] + [("style/none.md", None, "high", "t", None, 0, None, None), ("style/dots.md", [], "high", "t", None, 0, None, ". ...")]
    docs = frame(spark, files)
    want = I.build_index(docs, keep=True)
    assert I.write_postings(docs.limit(0), str(tmp_path / "none")).count() == spark.read.parquet(str(tmp_path / "none")).count() == 0
    from lexispark.streaming.corpus import Corpus

    corpus = Corpus(spark, str(tmp_path / "c"))
    corpus.publish(docs)
    got = corpus.current()
    assert got.chunks.columns == ["path", "chunk_id", "word_count"] and not list((tmp_path / "c").rglob("*.cut"))
    keys = spark.createDataFrame([("style/1.md", 0)], "path string, chunk_id int")
    assert rows(got.texts(keys)) == rows(want.texts(keys)) != []
    for name in ("chunks", "documents", "postings", "stats"):
        assert rows(getattr(got, name)) == rows(getattr(want, name), getattr(got, name).columns), name


def test_many_tombstones_meet_postings_by_hash(spark, tmp_path, monkeypatch):
    """More tombstones than may be broadcast as paths shuffled all postings; paths of one hash are still told apart."""
    from lexispark.operators import segments

    rng = random.Random(4)
    files = {f"style/{k}.md": file(rng, f"style/{k}.md") for k in range(40)}
    corpus = SegmentedCorpus(spark, str(tmp_path / "c"))
    corpus.publish(frame(spark, files.values()))
    files = {p: file(rng, p) if k % 5 == 0 else f for k, (p, f) in enumerate(files.items()) if k % 7}
    corpus.publish(frame(spark, files.values()))
    want = rows(corpus.current().postings)
    monkeypatch.setattr(segments, "FEW", 0)
    assert rows(corpus.current().postings) == want
    assert corpus.current().postings._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0
    monkeypatch.setattr(segments, "path_key", lambda name: F.length(name).cast("long"))
    assert rows(corpus.current().postings) == want
