"""Benchmark passages in documents: a set join on the rarest shingle of each item window, with exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.runtime import checkpointed, read_table, small_batches, small_side

from .text import let_go, slices
from .tokens import ALNUM, bitmap, in_bitmap, runs_of, signed, split_words

WINDOW, SHINGLE = 10, 5
#: Distinct shingles that a task holds before it passes on their counts; windows of about 150 bytes that may be broadcast.
TALLY, FEW = 1 << 20, 200_000


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """(item, window, size, shingles): an item's runs of `window` words, or all its words if they are fewer, with the hashes of their shingles in order."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = split_words(part.column(1), ALNUM)
                h, names, ends = w.hashes()[w.code], w.vocabulary.cast(pa.large_string()).to_pylist(), np.cumsum(w.counts(part.num_rows))
                out = []
                for item, end, begin in zip(part.column(0).to_pylist(), ends.tolist(), [0, *ends[:-1].tolist()]):
                    size = min(window, end - begin)
                    if size:
                        of, each = runs_of(h[begin:end], min(shingle, size)).view(np.int64), size - min(shingle, size) + 1
                        own = [names[c] for c in w.code[begin:end]]
                        out += [(item, own[k : k + size], size, of[k : k + each].tolist()) for k in range(end - begin - size + 1)]
                for at in range(0, len(out), 10_000):
                    item, words, size, of = zip(*out[at : at + 10_000])
                    columns = pa.array(item, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(size, pa.int32()), pa.array(of, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(list(columns), ["item", "window", "size", "shingles"])

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "item string, window array<string>, size int, shingles array<long>")


def _found(part: pa.RecordBatch, lengths: list[int], packed: np.ndarray):
    """Words of a slice of documents, and (place, hash) of the shingles of given lengths that the bitmap holds."""
    w = split_words(part.column(part.schema.get_field_index("text")), ALNUM)
    h = w.hashes()[w.code]
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in lengths:
        r = runs_of(h, n)
        at = np.flatnonzero(in_bitmap(packed, r) & (w.text[: len(r)] == w.text[n - 1 : n - 1 + len(r)]))
        places.append(at)
        hashes.append(r[at])
    return w, np.concatenate(places), np.concatenate(hashes)


def shingle_counts(rows: DataFrame, lengths: list[int], packed: np.ndarray) -> DataFrame:
    """(shingle, n): how often documents hold the shingles of a bitmap, added up within tasks first."""
    shared = rows.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        let_go()
        held, amount = [], 0

        def tally():
            x, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([v for _, v in held])).astype(np.int64)
            return x, n

        for batch in batches:
            for part in slices(batch, "text"):
                held.append(np.unique(_found(part, lengths, shared.value)[2], return_counts=True))
                amount += len(held[-1][0])
                if amount >= TALLY:
                    held = [tally()]
                    amount = len(held[0][0])
                    if amount >= TALLY // 2:
                        yield pa.RecordBatch.from_arrays([signed(held[0][0]), pa.array(held[0][1])], ["shingle", "n"])
                        held, amount = [], 0
        if held:
            x, n = tally()
            yield pa.RecordBatch.from_arrays([signed(x), pa.array(n)], ["shingle", "n"])

    return rows.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def rarest_shingles(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(shingle, window, size, at): the necessary prefix of each distinct window, its rarest shingle, and that shingle's place in it.

    Containment of the whole window allows no shingle to be missed, so the prefix is one shingle;
    a window with a shingle that no document has can't occur and is left out.
    """
    one = windows.groupBy("window", "size").agg(F.first("shingles").alias("shingles"))
    parts = one.select("window", "size", F.size("shingles").alias("all"), F.posexplode("shingles").alias("at", "shingle")).join(counts, "shingle")
    best = parts.groupBy("window", "size").agg(F.min(F.struct("n", "shingle", "at")).alias("b"), F.count(F.lit(1)).alias("k"), F.first("all").alias("all"))
    return best.filter("k = all").select("b.shingle", "window", "size", "b.at")


def prefix_hits(rows: DataFrame, kind: str, lengths: list[int], packed: np.ndarray, window: int, shingle: int) -> DataFrame:
    """A row (id, k1, k2, n_words) for each document and, with `shingle` and more, one for each place whose shingle the bitmap holds.

    `around` holds the words from `lead` before the place, as far as a window over it may reach.
    """
    shared = rows.sparkSession.sparkContext.broadcast(packed)
    schema = f"id {kind}, k1 long, k2 long, n_words long, shingle long, pos long, lead int, around array<string>"

    def run(batches):
        let_go()
        for batch in batches:
            for part in slices(batch, "text"):
                n, names = part.num_rows, ["id", "k1", "k2", "n_words", "shingle", "pos", "lead", "around"]
                w, at, hashes = _found(part, lengths, shared.value)
                count = w.counts(n)
                nothing = pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(count.astype(np.int64)), *nothing], names)
                ends = np.cumsum(count)
                for lo in range(0, len(at), 20_000):
                    i, of = at[lo : lo + 20_000], w.text[at[lo : lo + 20_000]]
                    begin = ends[of] - count[of]
                    first, stop = np.maximum(begin, i - (window - shingle)), np.minimum(ends[of], i + window)
                    sizes = stop - first
                    offsets = np.append(0, np.cumsum(sizes))
                    words = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first, sizes)
                    around = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), w.vocabulary.take(pa.array(w.code[words])).cast(pa.large_string()).cast(pa.string()))
                    own = [part.column(c).take(pa.array(of)) for c in range(3)]
                    columns = [*own, pa.array(count[of].astype(np.int64)), signed(hashes[lo : lo + 20_000]), pa.array(i - begin), pa.array((i - first).astype(np.int32)), around]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """One row per input row: id, n_words, n_hit (words inside any occurrence of an item's window), n_items, items_sha256, contaminated.

    Texts are words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lowered. An item gives windows of `window` words, or one of all
    its words. Shingles are ordered by how often the documents hold them; each distinct window is joined by its rarest one
    alone, which a document must have where the window occurs. The shingle's place gives the window's, so bounds of place
    and length come before the comparison of all its words.

    Two passes over the texts, each behind a bitmap of fixed size (`tokens.BITS`); only places of rarest shingles are
    shuffled, with a few words around each. Items and windows stay DataFrames: they are broadcast only if counted few,
    else joined by shuffles. A frequent passage gives a row per place; AQE splits its key, which the other side has once a window.

    Null and empty texts have no words; null item ids mark words as hit but aren't listed; repeated items count once. Rows
    are told apart by id and text, so repeated ids and null ids keep their own results and equal rows have equal ones. An
    empty table of items gives no hits, an empty table of documents no rows. Other columns aren't read.
    """
    spark, shingle = docs.sparkSession, min(shingle, window)
    row_id, text = F.col(id_col), F.col(text_col)
    rows = docs.select(row_id.alias("id"), F.xxhash64(row_id, text).alias("k1"), F.xxhash64(F.lit(WINDOW), text, row_id).alias("k2"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    windows = checkpointed(item_windows(items, item_col, item_text, window, shingle))
    lengths = [r["n"] for r in windows.select(F.least("size", F.lit(shingle)).alias("n")).distinct().orderBy("n").collect()]  # `shingle` rows at most

    with small_batches(spark):
        known = windows.select(F.explode("shingles").alias("shingle"))
        counts = shingle_counts(rows, lengths, bitmap(known, "shingle"))
        prefix = checkpointed(rarest_shingles(windows, counts))
        seen = checkpointed(prefix_hits(rows, kind, lengths, bitmap(prefix, "shingle"), window, shingle))

    hits = seen.filter(F.col("shingle").isNotNull()).join(small_side(prefix, FEW), "shingle")
    hits = hits.withColumn("start", F.col("pos") - F.col("at")).filter("start >= 0 AND start + size <= n_words AND lead >= at")
    same = F.slice("around", F.col("lead") - F.col("at") + 1, F.col("size")) == F.col("window")
    found = checkpointed(hits.filter(same).groupBy("k1", "k2", "start", "window").agg(F.first("size").alias("size")))

    key = ["k1", "k2"]
    spans = found.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop")))).alias("spans"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    covered = F.aggregate(
        "spans", none, lambda a, s: F.struct((a["n"] + F.greatest(s["stop"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], s["stop"]).alias("upto")), lambda a: a["n"]
    )
    owners = checkpointed(windows.filter(F.col("item").isNotNull()).select("window", "item").distinct())
    listed = found.select(*key, "window").distinct().join(small_side(owners, FEW), "window").select(*key, "item").distinct()
    listed = listed.groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    verdict = checkpointed(spans.select(*key, covered.alias("n_hit")).join(listed, key, "left"))

    out = seen.filter(F.col("shingle").isNull()).join(small_side(verdict, FEW), key, "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
w AS MATERIALIZED (
  SELECT DISTINCT item_id, size, array_to_string(ws[p : p + size - 1], ' ') AS win
  FROM (SELECT item_id, ws, least(10, len(ws)) AS size FROM i WHERE len(ws) > 0), unnest(range(1, len(ws) - size + 2)) u(p)),
o AS MATERIALIZED (
  SELECT doc_id, p, size, win
  FROM (SELECT doc_id, p, size, array_to_string(ws[p : p + size - 1], ' ') AS win FROM d, (SELECT DISTINCT size FROM w), unnest(range(1, len(ws) - size + 2)) u(p))
  SEMI JOIN w USING (win)),
h AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM o, unnest(range(0, size)) v(k) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o JOIN w USING (win)) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
