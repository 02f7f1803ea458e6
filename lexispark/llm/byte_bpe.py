"""Byte-level BPE by recursive queries of DuckDB in each partition."""

from __future__ import annotations

import base64
import itertools

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.runtime import read_table

from .text import held, slices

#: Words whose ids a worker remembers, and rows that a recursive query may hold, about: 60 bytes each.
MEMORY, ROWS = 600_000, 2_000_000
#: Steps that a long word counts for when words are dealt to queries.
STEPS = 64
#: Bytes of a word up to which a place or a size in it takes seven bits.
SHORT = 127

#: As `CONTRACT`, for words of `SHORT` bytes at most, a pair at a time: rank, pos, size and more of a word's first pair are one number.
CONTRACT_SHORT = """
WITH RECURSIVE steps AS (
  SELECT word, 0 AS step, pos, size, token, next, more, rank FROM positions
  UNION ALL
  (WITH least AS (SELECT word, min((rank::BIGINT << 21) + (pos << 14) + (size << 7) + more) AS pair FROM steps WHERE step < {steps} AND rank IS NOT NULL GROUP BY word),
  pairs AS (SELECT word, (pair >> 21)::INT AS rank, ((pair >> 14) & 127)::INT AS pos, ((pair >> 7) & 127)::INT AS size, (pair & 127)::INT AS more FROM least),
  taken AS (SELECT p.word, p.rank, p.pos, p.size + p.more AS whole, b.pos AS gone, b.next, b.more FROM pairs p JOIN steps b ON b.word = p.word AND b.pos = p.pos + p.size),
  moved AS (
    SELECT s.word, s.step + 1 AS step, s.pos, s.pos = t.pos AS here, s.pos + s.size = t.pos AS before,
      CASE WHEN here THEN t.whole ELSE s.size END AS size, CASE WHEN here THEN t.rank ELSE s.token END AS token,
      CASE WHEN here THEN t.next WHEN before THEN t.rank ELSE s.next END AS next,
      CASE WHEN here THEN t.more WHEN before THEN t.whole ELSE s.more END AS more, s.rank, here OR before AS changed
    FROM steps s JOIN taken t USING (word) WHERE s.pos <> t.gone)
  SELECT word, step, pos, size, token, next, more, CASE WHEN changed THEN m.rank ELSE moved.rank END
  FROM moved LEFT JOIN merges m ON m.first = CASE WHEN changed THEN token END AND m.second = next)
)
"""

#: Rows (word, step, pos, size, token, next, more, rank), pos and size in bytes, next and more being the token and size of
#: what follows and rank that of the two as a pair, lead to those of the next step, in which a word's
#: leftmost pair of least rank is one token, until no pair is left or the query's steps are used up.
#: Further pairs of that rank are what would come next, from the left and without overlaps, so
#: they are contracted in the same step: up to the first that makes a pair of no greater rank.
CONTRACT = """
WITH RECURSIVE steps AS (
  SELECT word, 0 AS step, pos, size, token, next, more, rank FROM positions
  UNION ALL
  (WITH least AS (SELECT word, min(rank) AS rank FROM steps WHERE step < {steps} GROUP BY word HAVING min(rank) IS NOT NULL),
  found AS MATERIALIZED (SELECT word, rank, pos, size, more FROM steps JOIN least USING (word, rank)),
  several AS MATERIALIZED (SELECT word, count(*) AS n FROM found GROUP BY word HAVING count(*) > 1),
  hits AS (
    SELECT word, rank, pos, size, more, n, row_number() OVER w AS k, lag(pos + size, 1, -1) OVER w = pos AS joined
    FROM found JOIN several USING (word) WINDOW w AS (PARTITION BY word ORDER BY pos)),
  runs AS (SELECT *, k - max(CASE WHEN joined THEN 0 ELSE k END) OVER (PARTITION BY word ORDER BY pos) AS place FROM hits),
  single AS (
    SELECT word, rank, pos, size, 1 AS k, 1 AS n, size + more AS whole FROM found ANTI JOIN several USING (word)
    UNION ALL SELECT word, rank, pos, size, k, n, size + more FROM runs WHERE place % 2 = 0),
  ends AS (
    SELECT t.word, t.rank, t.pos, t.k, t.n, t.whole, b.next, b.more, b.pos AS gone
    FROM single t JOIN steps b ON b.word = t.word AND b.pos = t.pos + t.size),
  open AS (SELECT word, rank, pos, next, k, own FROM ends JOIN early USING (rank) WHERE k < n),
  stops AS (
    SELECT word, min(k) AS stop FROM (
      SELECT word, k FROM open WHERE own
      UNION ALL SELECT o.word, o.k FROM open o JOIN steps p ON p.word = o.word AND p.pos + p.size = o.pos
        JOIN merges m ON m.first = p.token AND m.second = o.rank AND m.rank <= o.rank
      UNION ALL SELECT o.word, o.k FROM open o JOIN merges m ON m.first = o.rank AND m.second = o.next AND m.rank <= o.rank)
    GROUP BY word),
  taken AS MATERIALIZED (SELECT ends.* FROM ends LEFT JOIN stops USING (word) WHERE stop IS NULL OR k <= stop),
  moved AS (
    SELECT s.word, s.step + 1 AS step, s.pos, coalesce(t.whole, s.size) AS size, coalesce(t.rank, s.token) AS token,
      CASE WHEN f.rank IS NOT NULL THEN f.rank WHEN t.rank IS NOT NULL THEN t.next ELSE s.next END AS next,
      CASE WHEN f.rank IS NOT NULL THEN f.whole WHEN t.rank IS NOT NULL THEN t.more ELSE s.more END AS more,
      s.rank, t.rank IS NOT NULL OR f.rank IS NOT NULL AS changed
    FROM steps s SEMI JOIN least l ON l.word = s.word
    LEFT JOIN taken t ON t.word = s.word AND t.pos = s.pos
    LEFT JOIN taken f ON f.word = s.word AND f.pos = s.pos + coalesce(t.whole, s.size)
    ANTI JOIN taken g ON g.word = s.word AND g.gone = s.pos)
  SELECT word, step, pos, size, token, next, more, CASE WHEN changed THEN m.rank ELSE moved.rank END
  FROM moved LEFT JOIN merges m ON m.first = CASE WHEN changed THEN token END AND m.second = next)
)
"""


class Known:
    """Ids and decoded bytes of a word that a coder has met."""

    def __init__(self, coder: WordCoder):
        self.coder = coder

    def __getitem__(self, word: str) -> tuple[bytes, bytes]:
        ids = self.coder.ids[word]
        return ids, self.coder.decoded([ids])[0].as_py()


class WordCoder:
    """Encodes distinct words and decodes ids; a worker keeps one and the words it met."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ids: dict[str, bytes] = {}
        self.known = Known(self)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        merges = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        first, second, rank = (pa.array(c, pa.int32()) for c in zip(*merges))
        self._load("merges", {"first": first, "second": second, "rank": rank})
        tokens = {r: t for t, r in self.ranks.items()}
        self.tokens = pa.array([tokens.get(r) for r in range(max(tokens) + 1)], pa.large_binary())
        # tokens that may meet a neighbour, or one of their own, in a pair of no greater rank
        self.db.execute("CREATE TABLE early AS SELECT t AS rank, bool_or(other = t) AS own FROM (SELECT first AS t, second AS other, rank FROM merges UNION ALL SELECT second, first, rank FROM merges) WHERE rank <= t GROUP BY t")
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)

    def _load(self, name: str, columns: dict) -> None:
        self.db.register("rows_in", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows_in")
        self.db.unregister("rows_in")

    def _solve(self, words: list[str], raw: list[bytes]) -> None:
        """Contract words in recursive queries of so many steps that they hold `ROWS` rows at most; the last step's rows begin the next."""
        size = np.array([len(x) for x in raw])
        contract = CONTRACT_SHORT if size.max(initial=0) <= SHORT else CONTRACT
        whole = np.array([self.ranks.get(x, -1) for x in raw], np.int32)  # a word of the vocabulary is its own token
        word = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        pos = np.arange(len(word), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
        flat, open_ = np.frombuffer(b"".join(raw), np.uint8), np.repeat(whole < 0, size)
        token, last = self.single[flat], np.zeros(len(flat), bool)
        last[np.cumsum(size)[size > 0] - 1] = True
        after = np.append(flat[1:], 0)
        rank = np.where(last, -1, self.pairs[flat.astype(np.int32) * 256 + after])
        null = lambda x, where: pa.array(x[open_], pa.int32(), mask=where[open_])
        ones = np.ones(len(flat), np.int32)
        self._load("positions", {"word": word[open_], "pos": pos[open_].astype(np.int32), "size": ones[open_], "token": token[open_], "next": null(self.single[after], last), "more": null(ones, last), "rank": null(rank, rank < 0)})
        self._load("tokens", {"word": np.flatnonzero(whole >= 0).astype(np.int32), "pos": np.zeros(int((whole >= 0).sum()), np.int32), "token": whole[whole >= 0]})
        while rows := self.db.execute("SELECT count(*) FROM positions").fetchall()[0][0]:
            steps = max(4, min(1 << 20, ROWS // rows))
            self.db.execute(
                "CREATE OR REPLACE TABLE ended AS "
                + contract.format(steps=steps)
                + "SELECT word, step, pos, size, token, next, more, rank FROM steps JOIN (SELECT word, max(step) AS step FROM steps GROUP BY word) USING (word, step)"
            )
            self.db.execute(f"INSERT INTO tokens SELECT word, pos, token FROM ended WHERE step < {steps}")
            self.db.execute(f"CREATE OR REPLACE TABLE positions AS SELECT word, pos, size, token, next, more, rank FROM ended WHERE step = {steps}")
        coded = self.db.execute("SELECT word, pos, token FROM tokens").fetchnumpy()
        ids = np.asarray(coded["token"])[np.lexsort((coded["pos"], coded["word"]))].astype("<u4").tobytes()
        ends = np.append(0, 4 * np.cumsum(np.bincount(coded["word"], minlength=len(raw)))).tolist()
        self.ids.update(zip(words, map(ids.__getitem__, map(slice, ends[:-1], ends[1:]))))

    def decoded(self, ids: list[bytes]) -> pa.Array:
        """The bytes of each text's ids."""
        ends = np.append(0, np.cumsum([len(x) // 4 for x in ids]))
        parts = self.tokens.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        if parts.null_count:
            raise ValueError("an id that no token has")
        at = np.frombuffer(parts.buffers()[1], np.int64)[: len(parts) + 1][ends] if len(parts) else np.zeros(len(ends), np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at), parts.buffers()[2]]).cast(pa.binary())

    def learn(self, words: set[str]) -> None:
        """Words by length, in queries whose words' squared lengths (a long one's length times `STEPS`) come to `ROWS`, or of one word."""
        new = [w for w in words if w not in self.ids]
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        order = np.argsort([len(x) for x in raw], kind="stable").tolist()
        new, raw = [new[k] for k in order], [raw[k] for k in order]
        some, cost = 0, 0
        for k, x in enumerate(raw):
            own = len(x) * min(len(x), STEPS)
            if k > some and (cost + own > 3 * ROWS or len(raw[k - 1]) <= SHORT < len(x)):
                self._solve(new[some:k], raw[some:k])
                some, cost = k, 0
            cost += own
        if some < len(raw):
            self._solve(new[some:], raw[some:])


def worker_coder(path: str) -> WordCoder:
    coder = held(("bpe", path), lambda: WordCoder(path))
    if len(coder.ids) > MEMORY:
        for w in list(itertools.islice(coder.ids, MEMORY // 2)):  # the oldest half
            del coder.ids[w]
    return coder


def bpe_columns(df: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (little-endian unsigned 32-bit), decoded (bytes of the ids).

    Each match of the pattern is coded by itself, so a partition codes each
    distinct match once. Null and empty texts have no ids. Rows are
    independent: repeated rows repeat, no shuffle, memory bounded by slices of
    4 MB or one text. Other columns are not read.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                coder = worker_coder(path)
                found = [find(t) for t in part.column(1).to_pylist()]
                coder.learn(set().union(*found))
                ids = [b"".join(map(coder.ids.__getitem__, ms)) for ms in found]
                yield pa.RecordBatch.from_pydict({"id": part.column(0), "ids": pa.array(ids, pa.binary()), "decoded": coder.decoded(ids)})

    return rows.mapInArrow(run, "id long, ids binary, decoded binary").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_columns(read_table(spark, sf_dir, "documents"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
