"""Phrases whose words stand together more than their parts do, by suffix automata of shards."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.runtime import BROADCAST_ROWS, checkpointed, read_table, small_batches, small_side

from .text import drop_shuffles, let_go, mix, slices
from .tokens import PHRASE, Words, bitmap, in_bitmap, signed, split_words

LONGEST, LEAST, SHARE, TOP = 4, 30, 80, 2000
#: Bytes of text in a shard, about: an automaton holds some 40 bytes a word while it is built.
SHARD = 12 << 20


@dataclass
class Automaton:
    """States of a generalised suffix automaton that knows substrings up to a depth.

    A state stands for all substrings that end at the same places: those that end at `end` with `shortest` to
    `longest` words. `count` is the number of these places; `link` is the state of the longest shorter suffix (-1: none).
    """

    end: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray
    count: np.ndarray
    link: np.ndarray

    def substrings(self, least: int = 1, size: int | None = None):
        """(end, length, count) of the distinct substrings of `least` words or more, each once."""
        for n in range(least, (size or int(self.longest.max(initial=0))) + 1):
            has = (self.shortest <= n) & (self.longest >= n)
            yield self.end[has], n, self.count[has]


def automaton(codes: np.ndarray, begins: np.ndarray, depth: int) -> Automaton:
    """The automaton of all runs of `codes`; a run begins where `begins` says.

    The suffix links of an automaton are the tree of the reversed prefixes: places are grouped by the word that ends
    there, then by the word before it, and so on. A group that the next word before leaves whole is the same state, as its
    substrings end at the same places; groups that it splits become new states, linked to the one they come from.
    """
    n = len(codes)
    places = np.arange(n)
    before = places - np.maximum.accumulate(np.where(begins, places, 0))  # words of the run before each place
    group, wide = np.unique(codes, return_inverse=True)[1], int(codes.max(initial=0)) + 1
    count = np.bincount(group) if n else np.zeros(0, np.int64)
    end = np.zeros(len(count), np.int64)
    end[group] = places
    shortest, longest, link = np.ones(len(count), np.int64), np.ones(len(count), np.int64), np.full(len(count), -1)
    state = np.arange(len(count))  # of each group
    for length in range(2, depth + 1):
        longer = before[places] >= length - 1
        places, group = places[longer], group[longer]
        if not len(places):
            break
        _, first, now = np.unique(group * wide + codes[places - length + 1], return_index=True, return_inverse=True)
        size, old = np.bincount(now), state[group[first]]
        whole = size == count[old]
        longest[old[whole]] = length
        fresh = int((~whole).sum())
        state = np.where(whole, old, len(count) - 1 + np.cumsum(~whole))
        end, count = np.append(end, places[first[~whole]]), np.append(count, size[~whole])
        shortest, longest = np.append(shortest, np.full(fresh, length)), np.append(longest, np.full(fresh, length))
        link, group = np.append(link, old[~whole]), now
    return Automaton(end, shortest, longest, count, link)


def _shards(batches):
    """(language, texts) in portions of about `SHARD` bytes, each of one language."""
    held: dict[str, list[pa.Array]] = {}
    amount = 0
    for batch in batches:
        for part in slices(batch, "text"):
            langs = part.column(0).dictionary_encode()
            of = langs.indices.to_numpy(zero_copy_only=False)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                held.setdefault(lang, []).append(part.column(1).filter(pa.array(of == k)))
            amount += part.column(1).nbytes
            if amount >= SHARD:
                for lang, texts in held.items():
                    yield lang, pa.concat_arrays(texts)
                held, amount = {}, 0
    for lang, texts in held.items():
        yield lang, pa.concat_arrays(texts)


def _tag(lang: str) -> np.uint64:
    from xxhash import xxh3_64_intdigest

    return np.uint64(xxh3_64_intdigest(lang.encode()))


def _gram_hashes(w: Words, lang: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the `length` words that end at each place, and whether they lie in one piece."""
    h = (w.hashes() ^ _tag(lang))[w.code]
    before = np.arange(len(h)) - np.maximum.accumulate(np.where(w.begins, np.arange(len(h)), 0))
    out = h
    with np.errstate(over="ignore"):
        for _ in range(length - 1):
            out = mix(mix(np.append(np.uint64(0), out[:-1])) + h)
    return out, before >= length - 1


def phrase_hashes(phrases: DataFrame, length: int) -> DataFrame:
    """(hash) of phrases (lang, phrase), as `frequent_runs` finds them in texts."""

    def run(batches):
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            of = langs.indices.to_numpy(zero_copy_only=False)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                h, whole = _gram_hashes(split_words(batch.column(1).filter(pa.array(of == k)), PHRASE), lang, length)
                yield pa.RecordBatch.from_arrays([signed(h[whole])], ["hash"])

    return phrases.select("lang", "phrase").mapInArrow(run, "hash long")


def frequent_runs(w: Words, lang: str, length: int, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and begins of runs that hold all phrases of `length` words both of whose shorter parts the bitmap holds.

    Each row of neighbouring parts is a run of its own, so two runs may share words, but no phrase of that length.
    """
    h, inside = _gram_hashes(w, lang, length - 1)
    good = inside & in_bitmap(packed, h)
    joined = good[1:] & good[:-1] & ~(w.begins[1:] if length == 2 else np.zeros(max(0, len(good) - 1), bool))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
    first, last = edge[::2] - (length - 2), edge[1::2]
    sizes = last - first + 1
    offsets = np.append(0, np.cumsum(sizes))
    begins = np.zeros(offsets[-1], bool)
    begins[offsets[:-1]] = True
    return w.code[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first, sizes)], begins


def phrase_counts(rows: DataFrame, length: int, packed: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, f) of phrases of `length` words; of two or more, those both of whose shorter parts the bitmap holds."""
    import pyarrow.compute as pc

    shared = rows.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        let_go()
        for lang, texts in _shards(batches):
            w = split_words(texts, PHRASE)
            code, begins = frequent_runs(w, lang, length, shared.value) if length > 1 else (w.code, w.begins)
            for end, _, count in automaton(code, begins, length).substrings(length, length):
                for lo in range(0, len(end), 100_000):
                    e = end[lo : lo + 100_000]
                    flat = code[(e[:, None] + np.arange(1 - length, 1)).ravel()]
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(e) + 1) * length, pa.int32()), w.vocabulary.take(pa.array(flat)).cast(pa.large_string()).cast(pa.string()))
                    columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(e), np.int32))), pc.binary_join(listed, " "), pa.array(count[lo : lo + 100_000])]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])

    return rows.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def whole(x: str | Column) -> Column:
    """A count as a decimal, so that products may pass 64 bits."""
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(19,0)")


def subsumed(phrases: DataFrame, share: int) -> DataFrame:
    """(lang, phrase) of phrases that a longer one has `share` percent of or more.

    Along its suffix link, and along that of the mirrored automaton, a phrase passes its count to what it is without its first
    and without its last word. Counts only fall with length, and what lies between two
    frequent phrases is one itself, so a phrase's neighbours one word longer decide.
    """
    longer = phrases.filter("words > 2")
    first, last = F.expr("substring(phrase, instr(phrase, ' ') + 1)"), F.expr("substring_index(phrase, ' ', words - 1)")
    links = longer.select("lang", F.explode(F.array(first, last)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("more"))
    return phrases.join(links, ["lang", "phrase"]).filter(100 * whole("more") >= share * whole("f")).select("lang", "phrase")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are pieces between `[.,;:!?\\x0A-\\x0D]`, of words `[^\\x20\\x09]+` with A-Z lowered. Candidates are phrases of 2 to
    `longest` words that occur `least` times or more in a language; the score is the least of floor(2000000 a / (l + r)) over
    the cuts into two parts that occur l and r times; of n words in all. What a longer phrase subsumes goes.

    Shards of texts become suffix automata of bounded depth, whose states tell the counts of substrings; counts are added up
    by Spark. Both parts of a frequent phrase that are a word shorter are frequent, so a pass for each length counts only
    phrases whose parts the bitmap of the pass before holds; bitmaps have a fixed size (`tokens.BITS`) and may only hold too
    much. A phrase that all texts have is one row a shard before the shuffle, and a pass's shuffle goes before the next. The
    first `top` of each task go to a language's last task.

    Null texts are empty; a null language is `und`. Rows count each, repeated ones too; ids aren't read. An empty table gives
    an empty result. Other columns aren't read.
    """
    rows = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    with small_batches(df.sparkSession):
        single = checkpointed(phrase_counts(rows, 1))
        drop_shuffles(df.sparkSession)
        levels = [single.filter(F.col("f") >= least).withColumn("words", F.lit(1))]
        for length in range(2, longest + 1):
            known = bitmap(phrase_hashes(levels[-1], length - 1), "hash")
            found = phrase_counts(rows, length, known).filter(F.col("f") >= least)
            levels.append(checkpointed(found.withColumn("words", F.lit(length))))
            del found
            drop_shuffles(df.sparkSession)

    phrases = reduce(DataFrame.unionByName, levels[1:])
    parts = small_side(checkpointed(reduce(DataFrame.unionByName, levels[:-1]).drop("words")), BROADCAST_ROWS // 8)
    kept = phrases.join(subsumed(phrases, share), ["lang", "phrase"], "left_anti")
    split = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(split, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(split, F.col("k") + 1, F.col("words")), " ").alias("rest"))
    x = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    x = x.withColumn("score", F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    best = x.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = single.groupBy("lang").agg(F.sum("f").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT lang, doc_id, k, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda w: w <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, doc_id, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
        FROM documents WHERE text IS NOT NULL),
    unnest(range(1, len(ps) + 1)) u(k), unnest([ps[k]]) v(piece)),
g AS MATERIALIZED (
  SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase, count(*) AS f
  FROM p, unnest([1, 2, 3, 4]) s(m), unnest(range(1, len(ws) - m + 2)) u(i) GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, f AS a FROM g WHERE m > 1 AND f >= 30),
inner_ AS (SELECT lang, a, array_to_string(ws[i : i + n - 1], ' ') AS phrase FROM c, unnest(range(2, m)) s(n), unnest(range(1, m - n + 2)) u(i)),
gone AS (SELECT DISTINCT lang, phrase FROM inner_ x JOIN c USING (lang, phrase) WHERE 100::HUGEINT * x.a >= 80::HUGEINT * c.a),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f)::HUGEINT)::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c ANTI JOIN gone USING (lang, phrase)) c
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : k], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1 : c.m], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1))
SELECT lang, rank, phrase, a, l, r, n, score FROM b JOIN t USING (lang) WHERE rank <= 2000
"""
