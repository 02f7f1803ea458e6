"""Singular vectors of a matrix of terms and members (documents or chunks), by block Lanczos steps over files in the shared folder.

A matrix is a row for each term: `at` (numbers of the members that have it, unsigned 32-bit) and `tf`. Blocks of vectors over
members are files of `MEMBERS` rows each; a task reads one block of `WIDTH` vectors whole, and the driver holds only products of vectors with vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.runtime import checkpointed, drop_shuffles, scratch
from lexispark.sources.sink import Folder

#: Vectors of a block, members of a file, entries of the matrix that a task multiplies at once (or twice the members, if more).
WIDTH, MEMBERS, ENTRIES = 10, 8192, 1 << 18
#: Residual of the last vector asked for, against its eigenvalue, at which the steps end.
TOLERANCE = 1e-8


def saved_rows(entries: DataFrame, least: int = 1, vectors: DataFrame | None = None) -> DataFrame:
    """(term, at, tf) of entries (term, n, tf), written once, with idf and vec of `vectors` (term, idf, vec) if given; terms of fewer than `least` members are left out."""
    x = entries.groupBy("term").agg(F.collect_list(F.struct("n", "tf")).alias("e")).filter(F.size("e") >= least)
    x = x.select("term", F.col("e.n").alias("n"), F.col("e.tf").alias("tf"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                s = b.slice(at, 1024)
                n, tf = (([x.astype("<u4").tobytes() for x in _lists(s.column(k))]) for k in ("n", "tf"))
                yield pa.RecordBatch.from_arrays([s.column("term"), pa.array(n, pa.binary()), pa.array(tf, pa.binary())], ["term", "at", "tf"])

    spark = entries.sparkSession
    path, rows = scratch(spark, "terms"), x.mapInArrow(run, "term string, at binary, tf binary")
    rows = rows if vectors is None else rows.join(vectors, "term")
    rows.write.parquet(path)
    drop_shuffles(spark)
    return spark.read.schema(rows.schema).parquet(path)


def _lists(column: pa.ListArray):
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return (flat[a:b] for a, b in zip(ends[:-1], ends[1:]))


class Vectors:
    """Blocks of vectors over `n` members, as files under a folder that driver and executors share."""

    def __init__(self, root: str, n: int):
        self.root, self.n, self.files = root, n, -(-n // MEMBERS)

    def size(self, d: int) -> int:
        return min(self.n, (d + 1) * MEMBERS) - d * MEMBERS

    def put(self, name: str, d: int, x: np.ndarray) -> None:
        Folder(self.root).write(f"{name}/{d}", np.ascontiguousarray(x, "<f8").tobytes())

    def get(self, name: str, d: int) -> np.ndarray:
        return np.frombuffer(Folder(self.root).read(f"{name}/{d}"), "<f8").reshape(-1, self.size(d))

    def whole(self, name: str) -> np.ndarray:
        return np.concatenate([self.get(name, d) for d in range(self.files)], axis=1)

    def drop(self, name: str) -> None:
        Folder(self.root).remove(name)


def idf(at: list[bytes], n: int) -> np.ndarray:
    return np.log(n / np.array([len(x) // 4 for x in at], float))


def _entries(at: list[bytes], tf: list[bytes], weight: np.ndarray, most: int):
    """A matrix's rows in parts of about `most` entries: (first row, last row, entries of each, members, values)."""
    size = np.array([len(x) // 4 for x in at], np.int64)
    ends, k = np.cumsum(size), 0
    while k < len(size):
        to = max(k + 1, int(np.searchsorted(ends, ends[k] - size[k] + most, "right")))
        n = np.frombuffer(b"".join(at[k:to]), "<u4").astype(np.int64)
        yield k, to, size[k:to], n, np.log1p(np.frombuffer(b"".join(tf[k:to]), "<u4")) * np.repeat(weight[k:to], size[k:to])
        k = to


def _from_members(x: np.ndarray, size: np.ndarray, n: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each term the sum of a vector over its members."""
    return np.add.reduceat(x[n] * value, np.cumsum(size) - size)


def _to_members(z: np.ndarray, size: np.ndarray, n: np.ndarray, value: np.ndarray, members: int) -> np.ndarray:
    """For each member the sum of its terms' numbers."""
    return np.bincount(n, weights=value * np.repeat(z, size), minlength=members)


def _by_file(out: np.ndarray):
    for d in range(-(-out.shape[1] // MEMBERS)):
        x = np.ascontiguousarray(out[:, d * MEMBERS : (d + 1) * MEMBERS])
        if x.any():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "x": pa.array([x.tobytes()], pa.binary())})


def _few(rows: DataFrame) -> DataFrame:
    """One task a core, as each sends a block of vectors."""
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)


def _product(rows: DataFrame, v: Vectors, name: str) -> DataFrame:
    """(d, x): parts of A'A times the vectors `name`; a term's row gives its own number and what that adds to its members."""

    def run(batches):
        x = v.whole(name)
        out = np.zeros_like(x)
        for b in batches:
            at, tf = b.column("at").to_pylist(), b.column("tf").to_pylist()
            for _, _, size, n, value in _entries(at, tf, idf(at, v.n), max(ENTRIES, 2 * v.n)):
                for c in range(len(x)):
                    out[c] += _to_members(_from_members(x[c], size, n, value), size, n, value, v.n)
        yield from _by_file(out)

    return _few(rows.select("at", "tf")).mapInArrow(run, "d int, x binary")


def _sums(table: pa.Table) -> np.ndarray:
    total = 0
    for x in table["x"]:
        total = total + np.frombuffer(x.as_buffer(), "<f8")
    return total


def _each(spark, v: Vectors, f) -> np.ndarray:
    """The sum of what `f` makes of each file of members."""
    return spark.sparkContext.parallelize(range(v.files), min(v.files, spark.sparkContext.defaultParallelism)).map(f).treeReduce(lambda a, b: a + b)


def _multiplied(rows: DataFrame, v: Vectors, name: str, to: str) -> None:
    """Write A'A times the vectors `name`."""

    def write(table: pa.Table) -> pa.Table:
        d = table["d"][0].as_py()
        v.put(to, d, _sums(table))
        return pa.table({"d": pa.array([d], pa.int32())})

    done = {r["d"] for r in _product(rows, v, name).groupBy("d").applyInArrow(write, "d int").collect()}
    width = WIDTH if v.n > WIDTH else v.n
    for d in set(range(v.files)) - done:  # members without a term
        v.put(to, d, np.zeros((width, v.size(d))))


def decomposed(rows: DataFrame, n: int, dims: int) -> tuple[Vectors, list[str]]:
    """Files with the right singular vectors of A, each divided by its singular value, `WIDTH` to a name; at most `dims`, largest first.

    Block Lanczos: the vectors so far are orthonormal, what A'A makes of the last block is made orthogonal to them (twice), and
    what is left is the next block. Steps go on until the residuals of the `dims` largest Ritz pairs are `TOLERANCE` of the
    last one's eigenvalue, or nothing is left. The projected matrix, a few hundred rows, is the driver's only large object.
    """
    spark = rows.sparkSession
    v = Vectors(scratch(spark, "lanczos"), n)
    width = min(WIDTH, n)

    def begin(d):
        x = np.random.default_rng([7, d]).normal(size=(width, v.size(d)))
        v.put("left", d, x)
        return x @ x.T

    gram, widths, h, k, least = _each(spark, v, begin), [], np.zeros((0, 0)), 0, 0.0
    while True:
        # the next block: an orthonormal basis of what is left, by its Gram matrix
        g, u = np.linalg.eigh(gram)
        keep = g > max(1e-14 * g[-1], least)
        if not keep.any():
            break
        turn = (u[:, keep] / np.sqrt(g[keep])).T
        _each(spark, v, lambda d, k=k, turn=turn: v.put(f"q{k}", d, turn @ v.get("left", d)) or 0)
        before, here = sum(widths), int(keep.sum())
        grown = np.zeros((before + here, before + here))
        grown[:before, :before] = h
        widths.append(here)
        _multiplied(rows, v, f"q{k}", "left")

        def against(d, taken=None):
            w = v.get("left", d)
            if taken is not None:
                at = 0
                for j, size in enumerate(widths):
                    w = w - taken[at : at + size].T @ v.get(f"q{j}", d)
                    at += size
                v.put("left", d, w)
            return np.vstack([*(v.get(f"q{j}", d) @ w.T for j in range(len(widths))), w @ w.T])

        first = _each(spark, v, against)[: before + here]
        second = _each(spark, v, lambda d, c=first: against(d, c))[: before + here]
        third = _each(spark, v, lambda d, c=second: against(d, c))
        gram, column = third[before + here :], first + second
        grown[:, before:] = column
        grown[before:, :] = column.T
        h, k = (grown + grown.T) / 2, k + 1
        if k % 4 == 0:
            drop_shuffles(spark)
        values, ritz = np.linalg.eigh(h)
        top = ritz[-here:, -dims:]
        residual = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", top, gram, top), 0))
        least = (1e-12 * values[-1]) ** 2
        if len(values) >= dims and residual.max() <= TOLERANCE * values[-dims]:
            break
    order = np.argsort(values)[::-1][:dims]
    order = order[values[order] > max(1e-9, 1e-12 * values[-1])]
    scaled = (ritz[:, order] / np.sqrt(values[order])).T
    names = [f"v{j}" for j in range(0, len(order), WIDTH)]

    def finish(d):
        for j, name in zip(range(0, len(order), WIDTH), names):
            at, total = 0, 0
            for q, size in enumerate(widths):
                total = total + scaled[j : j + WIDTH, at : at + size] @ v.get(f"q{q}", d)
                at += size
            v.put(name, d, total)
        return 0

    _each(spark, v, finish)
    for name in ["left", *(f"q{j}" for j in range(k))]:
        v.drop(name)
    drop_shuffles(spark)
    return v, names


def term_vectors(rows: DataFrame, v: Vectors, names: list[str]) -> DataFrame:
    """(term, idf, vec): A times the vectors, a pass for each name."""

    def part(name):
        def run(batches):
            x = v.whole(name)
            for b in batches:
                at, tf = b.column("at").to_pylist(), b.column("tf").to_pylist()
                weight, out = idf(at, v.n), np.zeros((len(x), len(at)))
                for k, to, size, n, value in _entries(at, tf, weight, ENTRIES):
                    for c in range(len(x)):
                        out[c, k:to] = _from_members(x[c], size, n, value)
                yield pa.RecordBatch.from_arrays([b.column("term"), pa.array(weight), pa.array(list(out.T), pa.list_(pa.float64()))], ["term", "idf", "e"])

        return run

    parts = [rows.mapInArrow(part(name), "term string, idf double, e array<double>").withColumn("k", F.lit(k)) for k, name in enumerate(names)]
    if len(parts) == 1:
        return parts[0].select("term", "idf", F.col("e").alias("vec"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    ordered = F.array_sort(F.collect_list(F.struct("k", "e")))
    return both.groupBy("term").agg(F.first("idf").alias("idf"), F.flatten(F.transform(ordered, lambda x: x["e"])).alias("vec"))


def member_vectors(rows: DataFrame, n: int, dims: int) -> DataFrame:
    """(n, vec): for each of `n` members the sum of ln(1 + tf) * idf * vec of its terms, from rows (term, at, tf, idf, vec); those without a term are left out.

    A pass for each `WIDTH` dimensions, in which a task adds up members for its terms.
    """

    def part(begin, end):
        def run(batches):
            out, seen = np.zeros((end - begin + 1, n)), end - begin
            for b in batches:
                if not b.num_rows:
                    continue
                at, tf = b.column("at").to_pylist(), b.column("tf").to_pylist()
                vec = np.array(b.column("vec").to_pylist(), float)
                for k, to, size, members, value in _entries(at, tf, b.column("idf").to_numpy(), max(ENTRIES, 2 * n)):
                    for c in range(end - begin):
                        out[c] += _to_members(vec[k:to, c], size, members, value, n)
                    out[seen, members] = 1
            yield from _by_file(out)

        def whole(table: pa.Table) -> pa.Table:
            d = table["d"][0].as_py()
            x = _sums(table).reshape(end - begin + 1, -1)
            here = np.flatnonzero(x[seen_row])
            return pa.table({"n": pa.array(here + d * MEMBERS), "e": pa.array(list(x[:-1, here].T), pa.list_(pa.float64()))})

        seen_row = end - begin
        some = rows.select("at", "tf", "idf", F.slice("vec", begin + 1, end - begin).alias("vec"))
        return _few(some).mapInArrow(run, "d int, x binary").groupBy("d").applyInArrow(whole, "n long, e array<double>").withColumn("k", F.lit(begin))

    parts = []
    for k in range(0, dims, WIDTH):
        parts.append(checkpointed(part(k, min(k + WIDTH, dims))))
        drop_shuffles(rows.sparkSession)
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    ordered = F.array_sort(F.collect_list(F.struct("k", "e")))
    return both.groupBy("n").agg(F.flatten(F.transform(ordered, lambda x: x["e"])).alias("vec"))
