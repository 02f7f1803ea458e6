"""Importance resampling towards a target distribution, over hashed word features of distinct texts."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.runtime import BROADCAST_ROWS, checkpointed, ranked, read_table, small_batches, small_side

from .text import let_go, slices
from .tokens import ALNUM, split_words

LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024


def _buckets(part: pa.RecordBatch, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of a slice, features of a text side by side, and each text's words."""
    w = split_words(part.column(part.schema.get_field_index("text")), ALNUM)
    words, n = w.vocabulary.to_pylist(), len(w.code)
    one = np.fromiter((zlib.crc32(x) % buckets for x in words), np.int64, len(words))[w.code]
    texts, found = [w.text], [one]
    joined = [words[c] for c in w.code] if longest > 1 else []
    for k in range(2, longest + 1):
        at = np.flatnonzero(w.text[: max(0, n - k + 1)] == w.text[k - 1 :])
        texts.append(w.text[at])
        found.append(np.fromiter((zlib.crc32(b" ".join(joined[i : i + k])) % buckets for i in at.tolist()), np.int64, len(at)))
    text, bucket = np.concatenate(texts), np.concatenate(found)
    if longest > 1:
        order = np.argsort(text, kind="stable")
        text, bucket = text[order], bucket[order]
    return text, bucket, w.counts(part.num_rows)


def featurise(distinct: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(key, copies, one, n_words, features) for each distinct text, features being bucket numbers as bytes; and for each task
    rows (bucket, n) with what its texts add to the buckets, a text counted once for each copy."""

    def run(batches):
        let_go()
        total = np.zeros(buckets, np.int64)
        kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                text, bucket, count = _buckets(part, longest, buckets)
                copies = part.column(1).to_numpy()
                total += np.bincount(bucket, copies[text], buckets).astype(np.int64)
                ends = np.append(0, np.cumsum(np.bincount(text, minlength=n))) * kind.itemsize
                raw = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(bucket.astype(kind))]).cast(pa.binary())
                own = [part.column(0), part.column(1), part.column(2), pa.array(count.astype(np.int64)), raw, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(own, ["key", "copies", "one", "n_words", "features", "bucket", "n"])
        at = np.flatnonzero(total)
        nothing = [pa.nulls(len(at), t) for t in (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(at.astype(np.int32)), pa.array(total[at])], ["key", "copies", "one", "n_words", "features", "bucket", "n"])

    return distinct.select("key", "copies", "one", "text").mapInArrow(run, "key binary, copies long, one long, n_words long, features binary, bucket int, n long")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """What all rows (bucket, n) hold by bucket: `buckets` numbers reach the driver."""
    out = np.zeros(buckets, object)
    for r in rows.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the source, each count raised by one."""
    s_all, t_all, b = int(sum(source)), int(sum(target)), len(source)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b)))) for s, t in zip(source, target)], np.int64)


def weigh(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, copies, one, n_words, n_features, weight): the floored mean of a text's gains; 0 of none."""
    shared = texts.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        kind = np.dtype("<u2" if len(shared.value) <= 1 << 16 else "<u4")
        for part in batches:
            raw = part.column(4).cast(pa.large_binary())
            ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] // kind.itemsize
            data = raw.buffers()[2]
            flat = np.frombuffer(data, kind)[ends[0] : ends[-1]] if data is not None and len(raw) and ends[-1] > ends[0] else np.zeros(0, kind)
            sums = np.append(0, np.cumsum(shared.value[flat]))
            n = np.diff(ends)
            total = sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), pa.array(n), pa.array(weight)], ["key", "copies", "one", "n_words", "n_features", "weight"])

    x = texts.filter("bucket IS NULL").select("key", "copies", "one", "n_words", "features")
    return x.mapInArrow(run, "key binary, copies long, one long, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u by the first 8 hexadecimal digits of the sha256 of `seed:id`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, many: int) -> DataFrame:
    """(row, rank) of the `many` rows of highest score, ties to smaller ids.

    Scores are thousandths of logarithms, so there are some 100,000 different ones at most: their counts tell which score is
    the last to be drawn, and only rows from it on are ordered, by ranges.
    """
    counts = sorted(((r["score"], r["n"]) for r in scored.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    left, cut = many, None
    for score, n in counts:
        if left <= 0:
            break
        cut, left = score, left - n
    if cut is None:
        return scored.select("row", F.lit(0).cast("long").alias("rank")).limit(0)
    top = ranked(scored.filter(F.col("score") >= cut).select("id", "row", "score"), F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    return top.filter(F.col("rank") < many).select("row", (F.col("rank") + 1).alias("rank"))


def importance_sample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, seed: int = SEED, of_eligible: bool = False,
) -> DataFrame:
    """One row per input row: id, n_features, weight, score, rank (from 1, null where not drawn).

    Features are runs of 1 to `longest` words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lowered, in buckets by crc32.
    Identical texts are one: they are grouped by the whole text, features and weight come once for each, and its counts are
    multiplied by its copies. A text without copies carries its own id through; only rows of repeated texts are joined back
    to their text's weight, by the text's sha256, and get their own noise. `percent` of all rows (rounded down), or with
    `of_eligible` of those of `least_words` or more, are drawn from the latter by the highest weight plus noise.

    Texts are shuffled once; what is kept of them is a bucket number a feature. Driver and broadcasts hold one number a
    bucket, and one a different score. Copies meet in the map tasks first; in the join back the other side has one row a text.

    Null texts have no features and weight 0. A null id gets the noise of an empty one and comes last among ties; ids are
    whole numbers. Rows under one id with different texts are ranked apart, equal rows in some order. Empty tables give an
    empty result, an empty target one of equal shares. Other columns aren't read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("key")
    with small_batches(spark):
        grouped = rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("one")).select(digest, "copies", "one", "text")
        texts = checkpointed(featurise(grouped, longest, buckets))
        goal = target.select(F.lit(None).cast("binary").alias("key"), F.lit(1).cast("long").alias("copies"), F.lit(None).cast("long").alias("one"), F.col(target_text).alias("text"))
        wanted = bucket_counts(featurise(goal, longest, buckets), buckets)
    weights = checkpointed(weigh(texts, gains(bucket_counts(texts, buckets), wanted)))

    single = weights.filter("copies = 1").select(F.col("one").alias("id"), "key", "n_words", "n_features", "weight")
    many = weights.filter("copies > 1").select("key", "n_words", "n_features", "weight")
    repeated = rows.select("id", digest).join(small_side(many, BROADCAST_ROWS // 4), "key").select("id", "key", "n_words", "n_features", "weight")
    scored = single.unionByName(repeated).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = checkpointed(scored.select("id", F.monotonically_increasing_id().alias("row"), "n_words", "n_features", "weight", "score"))
    eligible = scored.filter(F.col("n_words") >= least_words)
    n = (eligible if of_eligible else scored).count()
    top = drawn(eligible, percent * n // 100)
    out = scored.join(top, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), of_eligible=True)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: crc32 by its table, which comes from the polynomial; only distinct words are hashed.
SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT {_WORDS} AS ws FROM benchmark),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
v AS MATERIALIZED (SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, strlen(w)), lambda k: ('0x' || hex(encode(w))[2 * k + 1 : 2 * k + 2])::BIGINT),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT unnest(ws) AS w FROM (SELECT ws FROM d UNION ALL SELECT ws FROM b)), tab),
f AS MATERIALIZED (SELECT doc_id, bucket, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) JOIN v USING (w) GROUP BY ALL),
s AS (SELECT bucket, sum(n) AS s FROM f GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(ws) AS w FROM b) JOIN v USING (w) GROUP BY bucket),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(n) AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM f JOIN g USING (bucket) GROUP BY doc_id),
a AS MATERIALIZED (SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM a WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM a) THEN rank END AS rank FROM a LEFT JOIN r USING (doc_id)
"""
