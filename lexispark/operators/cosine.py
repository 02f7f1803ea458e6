"""All pairs of sparse unit vectors that reach a cosine: candidates by blocks, then whole vectors."""

from __future__ import annotations

import hashlib
import io
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark import schema as S
from lexispark.functions import text as T
from lexispark.runtime import checkpointed, drop_shuffles, scratch, small_batches, small_side
from lexispark.sources.sink import Folder

#: Entries of vectors for a block, blocks if there are fewer (one under FEW entries), and products that a task sorts at a time.
ENTRIES, BLOCKS, FEW, PRODUCTS = 12_000_000, 5, 100_000, 1 << 20
#: Blocks by which whole vectors meet; one for each ten thousand pairs if those are more.
WHOLE = 8
#: Tasks at most that meet pairs of blocks.
TASKS = 1024
#: Terms whose counts may be broadcast: 64 MB.
MOST = 4_000_000
#: What rounding may take from a sum of products.
SLACK = 1e-6
_PREFIX = "id long, block int, keys binary, weights binary, rest binary"


def _half(x: np.ndarray) -> np.ndarray:
    """Half floats that aren't less than `x`."""
    h = x.astype(np.float16)
    return np.where(h < x, np.nextafter(h, np.float16(np.inf)), h).astype("<f2")


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and bounds, from 0, of a list column."""
    ends = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), ends - ends[0]


def prefixes(docs: DataFrame, threshold: float, blocks: int) -> DataFrame:
    """(id, block, keys, weights, rest) of (id, keys, levels, ws): a document's terms up to the level beyond which its length is
    under the threshold, without those of one document (level 0), and its length beyond each level up to there.

    Keys have 32 bits and numbers are rounded up, so sums of products may only come out too large.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            keys, ends = _lists(batch.column(1))
            levels, _ = _lists(batch.column(2))
            ws, _ = _lists(batch.column(3))
            out = []
            for d, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
                level, w = levels[lo:hi], ws[lo:hi]
                mass = np.bincount(level, w * w)
                rest = np.append(np.cumsum(mass[::-1])[::-1][1:], 0.0)
                last = int(np.argmax(rest < threshold * threshold - SLACK))
                at = np.flatnonzero((level <= last) & (level > 0))
                key = (keys[lo:hi][at] & 0xFFFFFFFF).astype("<u4")
                out.append((ids[d], key.tobytes(), _half(w[at]).tobytes(), _half(np.sqrt(rest[: last + 1])).tobytes()))
            columns = list(zip(*out)) or [(), (), (), ()]
            block = (np.array(columns[0], np.int64) * 0x9E3779B1 >> 13) % blocks
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(block.astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns[1:])], ["id", "block", "keys", "weights", "rest"]
            )

    return docs.select("id", "keys", "levels", "ws").mapInArrow(run, _PREFIX)


class _Block:
    def __init__(self, table: pa.Table):
        raw = [table.column(name).to_pylist() for name in ("keys", "weights", "rest")]
        self.ids = table.column("id").to_numpy()
        self.doc = np.repeat(np.arange(len(self.ids)), [len(x) // 4 for x in raw[0]])
        self.key = np.frombuffer(b"".join(raw[0]), "<u4")
        self.w = np.frombuffer(b"".join(raw[1]), "<f2").astype(np.float32)
        sizes = np.array([len(x) // 2 for x in raw[2]], np.int64)
        self.last, self.start = sizes - 1, np.cumsum(sizes) - sizes
        self.rest = np.frombuffer(b"".join(raw[2]), "<f2").astype(np.float32)


def _block(folder: str, k: int) -> _Block:
    at = Folder(folder)
    names = [n for n in at.names(f"block={k}") if n.endswith(".parquet")]
    kind = pa.schema([("id", pa.int64()), *((c, pa.binary()) for c in ("keys", "weights", "rest"))])
    return _Block(pa.concat_tables([kind.empty_table(), *(pq.read_table(io.BytesIO(at.read(f"block={k}/{n}")), columns=kind.names).cast(kind) for n in names)]))


def candidates(a: _Block, b: _Block, same: bool, threshold: float):
    """Ids (x, y), in pieces, of documents that may reach the threshold.

    Of two documents, all common terms of levels up to the lower of their last ones are in both prefixes. Their product
    is at most the sum over those and the product of their lengths beyond that level.
    """
    order = np.argsort(b.key, kind="stable")
    key, doc, w = b.key[order], b.doc[order], b.w[order]
    lo, n = np.searchsorted(key, a.key, "left"), len(b.ids)
    many = np.searchsorted(key, a.key, "right") - lo
    total = np.append(0, np.cumsum(many))
    ends = np.searchsorted(a.doc, np.arange(len(a.ids)), "right")  # entries are in order of documents
    first = d = 0
    while d < len(a.ids):
        d = max(d + 1, int(np.searchsorted(total[ends], total[first] + PRODUCTS, "right")))
        at = np.arange(first, ends[d - 1])
        first = int(ends[d - 1])
        c = many[at]
        place = np.repeat(lo[at] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        x, y, p = np.repeat(a.doc[at], c), doc[place], np.repeat(a.w[at], c) * w[place]
        if same:
            keep = x < y
            x, y, p = x[keep], y[keep], p[keep]
        if not len(x):
            continue
        code = x * n + y
        order = np.argsort(code)
        code = code[order]
        begins = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        part = np.add.reduceat(p[order].astype(np.float64), begins)
        x, y = code[begins] // n, code[begins] % n
        level = np.minimum(a.last[x], b.last[y])
        found = part + a.rest[a.start[x] + level].astype(np.float64) * b.rest[b.start[y] + level] >= threshold - SLACK
        yield a.ids[x[found]], b.ids[y[found]]


def _products(key, pairs, docs):
    """(a, b, similarity) of pairs (x, y) by the rows of all documents in them."""
    order = np.argsort(docs.column("id").to_numpy())
    ids = docs.column("id").to_numpy()[order]
    path = docs.column("path").to_pylist()
    rows = [(k, w) for c in docs.select(["keys", "ws"]).to_batches() for k, w in zip(*(np.split(v, e[1:-1]) for v, e in map(_lists, c.columns)))]
    out = []
    for x, y in zip(*(order[np.searchsorted(ids, pairs.column(c).to_numpy())] for c in ("x", "y"))):
        (kx, wx), (ky, wy) = rows[x], rows[y]
        _, i, j = np.intersect1d(kx, ky, assume_unique=True, return_indices=True)
        out.append((min(path[x], path[y]), max(path[x], path[y]), float(wx[i] @ wy[j])))
    a, b, s = zip(*out) if out else ((), (), ())
    return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "similarity": pa.array(s, pa.float64())})


def all_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs that reach `threshold` and are of one group; vectors are rows (path, term, n, w, g),
    n being the term's documents, g the path's group. Terms are known by 64 bits."""
    entry = F.struct(F.xxhash64("g", "term").alias("key"), _level(F.greatest("n", F.lit(1))).alias("level"), "w")
    one = vectors.groupBy("path").agg(F.collect_list(entry).alias("e"))
    rows = one.select("path", F.monotonically_increasing_id().alias("id"), F.col("e.key").alias("keys"), F.col("e.level").alias("levels"), F.col("e.w").alias("ws"))
    return row_pairs(checkpointed(rows), threshold)


def _level(n):
    return F.floor(4 * F.log2(n.cast("double"))).cast("int")


def _counts(docs: DataFrame, group) -> DataFrame:
    """(path, g, words, keys, fs): how often each chunk of a document has a term, and its tags (below 0), in one row, keys in order.

    Chunks and then tags are rows that a task passes on in the order of documents, so none is shuffled; it holds a batch and a document.
    """
    pieces = F.concat(F.transform(T.chunks(F.col("content")), lambda c: F.struct(F.lit(False).alias("tag"), c.alias("text"))), F.array(F.struct(F.lit(True).alias("tag"), F.concat_ws(" ", "tags").alias("text"))))
    x = docs.select("path", (F.xxhash64(group) if group is not None else F.lit(0).cast("long")).alias("g"), F.explode(pieces).alias("p"))
    rows = x.select("path", "g", "p.tag", T.tokens(F.col("p.text")).alias("tokens"))

    def counted(batch):
        lists = batch.column(3)
        tag = batch.column(2).to_numpy(zero_copy_only=False)
        of = np.append(0, np.cumsum(tag)[:-1])  # a document ends with its tags
        values, size = lists.flatten().dictionary_encode(), np.diff(lists.offsets.to_numpy())
        vocabulary = np.array([_key(t) for t in values.dictionary.to_pylist()], np.int64)
        part = np.repeat(np.arange(batch.num_rows), size)
        key = vocabulary[values.indices.to_numpy(zero_copy_only=False)] if len(part) else np.zeros(0, np.int64)
        order = np.lexsort((part, key, of[part]))
        key, part = key[order], part[order]
        new = np.ones(len(key), bool)
        new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1])
        at = np.flatnonzero(new)
        f = np.diff(np.append(at, len(key))) * np.where(tag[part[at]], -1, 1)
        ends = np.append(0, np.cumsum(np.bincount(of[part[at]], minlength=int(tag.sum())))).astype(np.int32)
        last = np.flatnonzero(tag)
        words = np.bincount(of, np.where(tag, 0, size), len(last)).astype(np.int64)
        lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (key[at], f.astype(np.int32))]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(last)), batch.column(1).take(pa.array(last)), pa.array(words), *lists], ["path", "g", "words", "keys", "fs"])

    def run(batches):
        held = []
        for batch in batches:
            last = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
            if not len(last):
                held.append(batch)
                continue
            whole = pa.Table.from_batches([*held, batch.slice(0, int(last[-1]) + 1)]).combine_chunks()
            held = [batch.slice(int(last[-1]) + 1)]
            yield counted(whole.to_batches()[0])

    return rows.mapInArrow(run, "path string, g long, words long, keys array<long>, fs array<int>")


def document_rows(docs: DataFrame, group=None) -> DataFrame:
    """(path, id, g, words, keys, levels, ws), a unit vector in one row for each document: `maintenance.document_vectors` without postings.
    g is a hash of `group`, which the keys don't contain: see `by_group`.

    Tokens are counted where the document is and written once, as a compressed table in the shared folder; weights are worked
    out anew when they are read. Only each task's counts of terms in documents are shuffled. Terms in two documents or more
    and their counts, 16 bytes each, go to the tasks by broadcast while there are MOST at most, else by a join.
    """
    spark = docs.sparkSession
    out = scratch(spark, "vectors")
    with small_batches(spark):
        _counts(docs, group).withColumn("id", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(out)
    counts = spark.read.parquet(out).select("path", "g", "words", "keys", "fs", "id")
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("words").alias("average")).first()
    n_docs, average = stats["n"], stats["average"] or 1.0
    shared_terms = checkpointed(counts.select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    known = None
    if shared_terms.count() <= MOST:
        table = shared_terms.toArrow()
        order = np.argsort(table.column("key").to_numpy())
        known = spark.sparkContext.broadcast((table.column("key").to_numpy()[order], table.column("n").to_numpy()[order]))
    else:
        each = counts.select("id", F.posexplode("keys").alias("k", "key")).join(shared_terms, "key", "left").select("id", "k", F.coalesce("n", F.lit(1)).alias("n"))
        ns = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda e: e["n"]).alias("ns"))
        counts = counts.join(ns, "id", "left").select("path", "g", "words", "keys", "fs", "id", F.coalesce("ns", F.array().cast("array<long>")).alias("ns"))

    def weighed(batches):
        for batch in batches:
            keys, ends = _lists(batch.column(3))
            f, _ = _lists(batch.column(4))
            if known is not None:
                all_keys, all_n = known.value
                at = np.minimum(np.searchsorted(all_keys, keys), max(len(all_keys) - 1, 0))
                n = np.where(all_keys[at] == keys, all_n[at], 1) if len(all_keys) else np.ones(len(keys), np.int64)
            else:
                n = _lists(batch.column(6))[0]
            doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            norm = S.K1 * (1 - S.B + S.B * batch.column(2).to_numpy()[doc] / average)
            v = np.abs(f) * (S.K1 + 1) / (np.abs(f) + norm) * np.where(f < 0, S.BOOST["tag"], S.BOOST["content"])
            new = np.ones(len(keys), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
            at = np.flatnonzero(new)
            v = np.add.reduceat(v, at) if len(at) else v
            keys, n, doc = keys[at], n[at], doc[at]
            w = v * np.log((n_docs - n + 0.5) / (n + 0.5) + 1.0)
            w = w / np.sqrt(np.bincount(doc, w * w, batch.num_rows))[doc]
            ends = np.append(0, np.cumsum(np.bincount(doc, minlength=batch.num_rows))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (keys, np.floor(4 * np.log2(n)).astype(np.int32), w)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), batch.column(1), batch.column(2), *lists], ["path", "id", "g", "words", "keys", "levels", "ws"])

    drop_shuffles(spark)
    return counts.mapInArrow(weighed, "path string, id long, g long, words long, keys array<long>, levels array<int>, ws array<double>")


def by_group(rows: DataFrame) -> DataFrame:
    """The rows with keys of their groups, so that only documents of one group share any."""
    return rows.withColumn("keys", F.transform("keys", lambda k: F.xxhash64(k, F.col("g"))))


def _key(token: str) -> int:
    """64 bits of a token's stem, alike on every machine; the rules are those of `text.stem`."""
    size = len(token.encode("utf-8", "surrogatepass"))
    cut = next((s for s in T.SUFFIXES if token.endswith(s) and size >= len(s) + 3), "")
    term = token[: len(token) - len(cut)]
    return int.from_bytes(hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def row_pairs(docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b, of rows (path, id, keys, levels, ws), which are read four times: keys of terms, floor(4 log2) of their documents, weights.

    A document's rarest terms, up to where the rest is shorter than the threshold, are its prefix; two documents
    that share no term there can't reach it. Prefixes (6 bytes a term) are dealt to blocks and written once in the shared folder, whatever the number of
    blocks; a task reads two of them there, sums products over prefixes, in pieces of about a million, and keeps a pair only if that sum and the lengths
    of the rests can reach the threshold. So no list of pairs that share a term is ever shuffled. What is kept is compared by
    whole vectors, which go only where a kept pair needs them. The number of products still grows faster than the corpus.
    """
    spark = docs.sparkSession
    entries = docs.agg(F.sum(F.size("keys"))).first()[0] or 0
    blocks = 1 if entries < FEW else max(BLOCKS, math.ceil(entries / ENTRIES))
    folder = scratch(spark, "prefixes")
    prefixes(docs, threshold, blocks).repartition("block").write.partitionBy("block").parquet(folder)
    drop_shuffles(spark)
    meetings = [(i, j) for i in range(blocks) for j in range(i, blocks)]

    def run(batches):
        held = {}
        for batch in batches:
            for i, j in (meetings[k] for k in batch.column(0).to_pylist()):
                held = {k: held[k] if k in held else _block(folder, k) for k in (i, j)}
                for x, y in candidates(held[i], held[j], i == j, threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])

    pairs = checkpointed(spark.range(0, len(meetings), 1, min(len(meetings), TASKS)).mapInArrow(run, "x long, y long"))
    Folder(folder).remove("")
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(max(WHOLE, pairs.count() // 10_000)))
    dealt = pairs.select("x", "y", F.least(block("x"), block("y")).alias("i"), F.greatest(block("x"), block("y")).alias("j"))
    needed = checkpointed(dealt.select("i", "j", F.col("x").alias("id")).unionByName(dealt.select("i", "j", F.col("y").alias("id"))).distinct())
    whole = docs.join(small_side(needed), "id").select("i", "j", "id", "path", "keys", "ws")
    out = dealt.groupBy("i", "j").cogroup(whole.groupBy("i", "j")).applyInArrow(_products, "a string, b string, similarity double")
    return out.filter(F.col("similarity") >= threshold - 1e-9)
