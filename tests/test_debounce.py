"""Bursts by event time and by the clock, restarts, and the index that follows them."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from lexispark import schema as S
from lexispark.operators.segments import SegmentedCorpus
from lexispark.streaming.debounce import debounced, joined, reindex_stream, started

T0 = dt.datetime(2025, 1, 1)


def sessions(times, quiet, restart=True):
    out = []
    for t in sorted(times):
        if out and t < (out[-1][1] if restart else out[-1][0]) + quiet:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


def test_joining_in_portions_is_joining_at_once():
    rng = random.Random(6)
    for _ in range(100):
        times = [rng.randint(0, 60) for _ in range(rng.randint(0, 25))]
        bursts = []
        for t in times:
            bursts = joined([*bursts, (t, t, 1)], 7, True)
        assert bursts == sessions(times, 7)
        assert joined([(t, t, 1) for t in times], 7, False) == sessions(times, 7, False)


@pytest.mark.parametrize("restart", [True, False])
def test_bursts_over_restarts_by_event_time(spark, tmp_path, restart):
    """Signals come in four runs of one checkpoint, out of order within the watermark."""
    rng = random.Random(3)
    signals = sorted((rng.randint(0, 200_000), rng.choice("ab")) for _ in range(120)) if restart else [(k * 900, "ab"[k % 2]) for k in range(120)]
    signals += [(400_000, "c"), (None, "a"), (5, None)]
    folder = tmp_path / "in"
    source = spark.readStream.schema("path string, ts timestamp_ntz, path_too int").parquet(str(folder / "*"))
    seen = []
    for k in range(4):
        part = signals[k * 32 : (k + 1) * 32]
        rng.shuffle(part)
        spark.createDataFrame([(p, None if t is None else T0 + dt.timedelta(milliseconds=t), 1) for t, p in part], "path string, ts timestamp_ntz, path_too int").write.parquet(str(folder / str(k)))
        started(debounced(source, ts="ts", late="50 seconds", quiet=4000, restart=restart), str(tmp_path / "state"), table=str(tmp_path / "out")).awaitTermination()
        seen.append(spark.read.parquet(str(tmp_path / "out")).count())
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    got = spark.read.parquet(str(tmp_path / "out")).select("path", F.unix_millis("first") - base, F.unix_millis("last") - base, "signals").collect()
    want = [(p, *b) for p in "ab" for b in sessions([t for t, q in signals if q == p and t is not None], 4000, restart)]
    assert sorted(map(tuple, got)) == sorted(want)  # c's burst is still open
    assert seen[0] < seen[-1]


def test_index_follows_bursts_by_the_clock(spark, tmp_path):
    """Ten saves of a file in a row are one version; a batch that is run again is none; a deleted file goes."""
    store = {"style/a.md": "one", "style/b.md": "two"}
    docs = lambda: spark.createDataFrame([(p, [], "low", "t", T0.date(), 0, None, c) for p, c in store.items()], S.DOCS)
    corpus = SegmentedCorpus(spark, str(tmp_path / "corpus"))
    corpus.publish(docs())
    folder = tmp_path / "in"
    put = lambda k, *paths: spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1).write.parquet(str(folder / str(k)))
    run = lambda: reindex_stream(
        spark.readStream.schema("path string").parquet(str(folder / "*")), corpus, lambda paths: docs().join(paths, "path", "left_semi"), str(tmp_path / "state"), quiet=15_000, processingTime="200 milliseconds"
    )
    put(0, *["style/a.md"] * 10)
    q = run()

    def until(versions):
        end = time.time() + 120
        while len(corpus.versions()) < versions and time.time() < end:
            assert q.exception() is None
            time.sleep(0.3)

    def taken(rows):
        end = time.time() + 90
        while sum(p["numInputRows"] for p in q.recentProgress) < rows and time.time() < end:
            time.sleep(0.2)

    try:
        taken(10)
        store["style/a.md"] = "changed"
        put(1, "style/a.md")
        until(2)
        assert len(corpus.versions()) == 2 and {r["path"]: r["content"] for r in corpus.current().docs.collect()} == {"style/a.md": "changed", "style/b.md": "two"}
        put(2, "style/b.md", "style/b.md")
        taken(13)
    finally:
        q.stop()
    assert len(corpus.versions()) == 2
    del store["style/b.md"]
    q = run()  # the timer is in the checkpoint
    try:
        until(3)
    finally:
        q.stop()
    assert len(corpus.versions()) == 3 and [r["path"] for r in corpus.current().docs.collect()] == ["style/a.md"]
