"""Near-duplicate documents: Jaccard join of word shingles with adaptive multi-match prefixes."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators.components import connected_components
from lexispark.runtime import BROADCAST_ROWS, checkpointed, read_table, small_batches, small_side

from .text import let_go, mix, slices, word_hashes, words

N, PERCENT = 5, 75
#: Longest prefix extension; most shingles whose estimated counts are known when prefixes are chosen.
LEVELS, FREQUENT = 4, 200_000
#: Shingles between two tallies of repeats in a partition.
TALLY = 1 << 21
#: Rows of a list from which its documents get a reference; pairs that share one copy of a text.
HOT, SHARE = 16, 4096
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB)]


def shingle_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-word shingles; a shorter text is one shingle, one without words has none."""
    split = [words(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    h = word_hashes(list(chain.from_iterable(split)))
    ends = np.cumsum(sizes)
    full = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        full += mix(h[k : k + len(full)] + _ODD[k % 8]) * _ODD[(k + 3) % 8]
    full = mix(full)
    out = []
    for size, end in zip(sizes.tolist(), ends.tolist()):
        if size >= n:
            x = np.sort(full[end - size : end - n + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        else:
            x = np.uint64(size)
            for w in h[end - size : end]:
                x = mix(np.array([x * _ODD[0] + w]))[0]
            out.append(np.array([x] if size else [], np.uint64))
    return out


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def profile(docs: DataFrame, n: int = N) -> DataFrame:
    """Rows (id, size, h1, h2) for documents and, where size is null, (shingle, its repeats h1) of a tally.

    h1 and h2 are a 128-bit hash of the set, whatever its order.
    """

    def run(batches):
        held, amount = [], 0

        def tally():
            x, k = np.unique(np.concatenate(held), return_counts=True)
            x, k = x[k > 1], k[k > 1]
            return pa.RecordBatch.from_arrays([_signed(x), pa.nulls(len(x), pa.int64()), pa.array(k), pa.nulls(len(x), pa.int64())], ["id", "size", "h1", "h2"])

        let_go()
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    sets = shingle_sets(part.column(1).to_pylist(), n)
                    h1, h2 = ([mix(s + _ODD[k]).sum(dtype=np.uint64) for s in sets] for k in (5, 6))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), _signed(h1), _signed(h2)], ["id", "size", "h1", "h2"])
                    held += sets
                    amount += sum(map(len, sets))
                    if amount >= TALLY:
                        yield tally()
                        held, amount = [], 0
            if amount:
                yield tally()

    return docs.mapInArrow(run, "id long, size long, h1 long, h2 long")


def choose_prefix(counts: np.ndarray, first: int, most: int) -> int:
    """How many matches to require: the level of least estimated cost.

    counts: estimated documents with each shingle, in order. A level reads
    one more list and needs one more match; its candidates are about the list
    entries beyond one's own over the matches needed, and each costs a comparison.
    """
    best, cost = 1, None
    for level in range(1, min(LEVELS, most) + 1):
        f = counts[: first + level - 1]
        now = f.sum() + 20 * (f - 1).sum() / level**2
        if cost is None or now < cost:
            best, cost = level, now
    return best


def prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], n: int = N, percent: int = PERCENT) -> DataFrame:
    """(shingle, id, size, level, need) for the shingles of each document's prefix.

    Order of shingles: infrequent ones by hash, then frequent ones by count.
    A shingle at place p belongs to levels from 1 + p - first on; a pair must share
    `need` (the lesser of the two) shingles whose levels are within it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        known, counts = shared.value
        let_go()
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    out = []
                    for doc, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), n)):
                        if not len(s):
                            continue
                        f = np.ones(len(s))
                        if len(known):
                            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                            f = np.where(known[at] == s, counts[at], 1)
                        least = (percent * len(s) + 99) // 100
                        first = len(s) - least + 1
                        order = np.argsort(f, kind="stable")[: first + LEVELS]
                        need = choose_prefix(f[order], first, least)
                        s = s[order[: first + need - 1]]
                        out.append((s, doc, need, first, least + first - 1))
                    if out:
                        sizes = [len(x[0]) for x in out]
                        level = np.concatenate([np.maximum(1, np.arange(len(x[0])) - x[3] + 2) for x in out])
                        fill = lambda k, kind: pa.array(np.repeat(np.array([x[k] for x in out], kind), sizes))  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([_signed(np.concatenate([x[0] for x in out])), fill(1, np.int64), fill(4, np.int32), pa.array(level.astype(np.int8)), fill(2, np.int8)], ["shingle", "id", "size", "level", "need"])

    return docs.mapInArrow(run, "shingle long, id long, size int, level tinyint, need tinyint")


def shared_postings(postings: DataFrame) -> DataFrame:
    """Postings of shingles that several documents have, with the first such document (head) and its size.

    One shuffle; each partition is read once in order, holding one row back.
    """

    def run(batches):
        held, last, head = None, None, (0, 0)
        for b in batches:
            t = pa.Table.from_batches([held, b] if held is not None else [b]).combine_chunks()
            s, d = t["shingle"].to_numpy(), t["id"].to_numpy()
            same = np.append(False if last is None else (s[0], d[0]) == last, (s[1:] == s[:-1]) & (d[1:] == d[:-1]))
            t = t.filter(pa.array(~same))
            s, d = s[~same], d[~same]
            held = None
            if not len(s):
                continue
            new = np.append(last is None or s[0] != last[0], s[1:] != s[:-1])
            if new[-1]:  # the first of its run: wait for what follows
                held = t.slice(len(s) - 1).to_batches()[0]
                t, s, d, new = t.slice(0, len(s) - 1), s[:-1], d[:-1], new[:-1]
                if not len(s):
                    continue
            keep = ~(new & np.append(new[1:], held is not None))
            at = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
            size = t["size"].to_numpy()
            heads, head_size = np.where(at < 0, head[0], d[at]), np.where(at < 0, head[1], size[at])
            last, head = (s[-1], d[-1]), (heads[-1], head_size[-1])
            t = t.append_column("head", pa.array(heads)).append_column("head_size", pa.array(head_size.astype(np.int32)))
            yield from t.filter(pa.array(keep)).combine_chunks().to_batches()

    ordered = postings.repartition("shingle").sortWithinPartitions("shingle", "id")
    return ordered.mapInArrow(run, "shingle long, id long, size int, level tinyint, need tinyint, head long, head_size int")


def compared(pairs: DataFrame, docs: DataFrame, n: int = N, rest: bool = False) -> DataFrame:
    """(a, b, size_a, size_b, common) by the whole shingle sets of each pair; with `rest` also b's shingles that a lacks.

    A text travels once for each pair that has it as b, and as a once for
    `SHARE` pairs: those of one a are dealt out, each share sorted behind a's own
    row, so a task holds one set at a time however many pairs an a has.
    """
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), "shares").cast("int").alias("share"))
    heads = shares.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    wanted = checkpointed(dealt.unionByName(heads).withColumn("id", F.coalesce("b", "a")))
    rows = docs.join(small_side(wanted, BROADCAST_ROWS // 2), "id").select("a", "share", "b", "text")
    rows = rows.repartition("a", "share").sortWithinPartitions("a", "share", F.asc_nulls_first("b"))
    names = ["a", "b", "size_a", "size_b", "common", *["rest"] * rest]

    def run(batches):
        head, last, held = None, None, np.array([], np.uint64)
        let_go()
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    out, lacked = [], []
                    keys = zip(*(part.column(c).to_pylist() for c in ("a", "share", "b")))
                    for (a, share, b), x in zip(keys, shingle_sets(part.column(3).to_pylist(), n)):
                        if b is None:
                            head, held = (a, share), x
                        elif head == (a, share) and last != (a, share, b):
                            found = np.isin(x, held, assume_unique=True)
                            out.append((a, b, len(held), len(x), int(found.sum())))
                            lacked.append(x[~found].view(np.int64))
                        last = a, share, b
                    columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(5)]
                    if rest:
                        ends = np.cumsum([0, *map(len, lacked)])
                        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lacked) if lacked else [], pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, ", ".join(f"{c} {'array<long>' if c == 'rest' else 'long'}" for c in names))


def similar(percent: int) -> Column:
    return 100 * F.col("common") >= percent * (F.col("size_a") + F.col("size_b") - F.col("common"))


def overlap_needed(a: str, b: str, percent: int) -> Column:
    """Shingles that sets of two sizes must share: percent / (100 + percent) of the sizes' sum, rounded up."""
    return F.expr(f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}")


def spare(a: str, b: str, percent: int) -> Column:
    """Shared shingles that prefixes must hold beyond the level, by the sizes of two documents.

    Similar sets share `overlap_needed`. What the prefixes of a
    level don't share lies behind the prefix that ends first, where a set has percent of
    its size less the level left; the prefixes must hold the rest.
    """
    left = F.expr(f"({percent} * greatest({a}, {b}) + 99) div 100")
    return F.greatest(overlap_needed(a, b, percent) - left, F.lit(0))


def fitting(a: str, b: str, percent: int) -> Column:
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def grouped(rows: DataFrame, components: DataFrame) -> DataFrame:
    """`rows` with the group of each id: its component, or itself."""
    return rows.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")


def main_cells(rows: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """(keys, main, rows): the commonest cell of each list that has several cells, and the list's length."""
    counts = rows.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("k"))
    lists = counts.groupBy(*keys).agg(F.max_by(cell, F.struct("k", cell)).alias("main"), F.sum("k").alias("rows"), F.count(F.lit(1)).alias("cells"))
    return checkpointed(lists.filter("cells > 1").drop("cells"))


def across(rows: DataFrame, keys: list[str], cell: str, meet: Column) -> DataFrame:
    """Pairs of a list's rows in different cells, columns x_ and y_: those outside its main cell meet the main cell's and, once, each other."""
    lists = main_cells(rows, keys, cell)
    mixed = rows.join(small_side(lists, BROADCAST_ROWS // 2), keys)
    side = lambda df, p: df.select(*keys, *(F.col(c).alias(p + c) for c in df.columns if c not in keys))
    x, y = side(mixed.filter(F.col(cell) != F.col("main")).drop("main", "rows"), "x_"), side(mixed.drop("rows"), "y_")
    once = (F.col(f"y_{cell}") == F.col("y_main")) | (F.col("x_id") < F.col("y_id"))
    return x.join(y, keys).filter(once & (F.col(f"x_{cell}") != F.col(f"y_{cell}")) & meet)


def references(named: DataFrame, ties: DataFrame) -> DataFrame:
    """(a, b): for each document b of long lists with several groups the document a to know it by.

    It is the centre of the group that is the main one of most of b's lists: the head that most members are tied to.
    """
    lists = main_cells(named, ["shingle"], "group").filter(F.col("rows") >= HOT)
    main = named.join(small_side(lists, BROADCAST_ROWS // 2), "shingle").groupBy("id", "main").agg(F.count(F.lit(1)).alias("k"))
    main = main.groupBy("id").agg(F.max_by("main", F.struct("k", -F.col("main"))).alias("group"))
    centres = ties.groupBy("group", "a").agg(F.count(F.lit(1)).alias("k")).groupBy("group").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a"))
    return main.join(centres, "group", "left").select(F.coalesce("a", "group").alias("a"), F.col("id").alias("b"))


def widened(known: DataFrame) -> DataFrame:
    """`known` with each reference taken to hold also what over half of its documents have beyond it, if these are `HOT` or more.

    Whatever set a reference is, what two documents share is at most the lesser
    of their overlaps with it and what they share outside. So any set may be
    added, if overlaps and rests are counted anew. A shingle that the
    centre happens to lack thus is no list of nearly all its documents. What is added to a
    reference is at most twice its documents' mean rest.
    """
    held = known.select("ref", F.explode("rest").alias("shingle")).groupBy("ref", "shingle").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= HOT)
    sizes = known.groupBy("ref").agg(F.count(F.lit(1)).alias("of"))
    more = held.join(sizes, "ref").filter("2 * k > of").groupBy("ref").agg(F.collect_list("shingle").alias("more"))
    left = F.when(F.col("more").isNull(), F.col("rest")).otherwise(F.array_except("rest", "more"))
    out = known.join(more, "ref", "left").withColumn("left", left).withColumn("o", F.col("o") + F.size("rest") - F.size("left"))
    return out.drop("rest", "more").withColumnRenamed("left", "rest")


def by_reference(known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents with one reference whose overlap may suffice; `known` has id, group, ref, size, o and rest.

    Two sets share at most the lesser of their overlaps o with the reference, and
    what they share outside it. So either they meet in a shingle that the reference
    lacks, of which all are listed, or both overlaps alone reach what is needed.
    """
    need = overlap_needed("x_size", "y_size", percent)
    bare = known.drop("rest")
    outside = across(known.select("ref", F.explode("rest").alias("shingle"), "id", "group", "size", "o"), ["ref", "shingle"], "group", fitting("x_size", "y_size", percent))
    pair = [F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")]
    first = outside.groupBy(*pair).agg(F.count(F.lit(1)).alias("k"), F.first(need - F.least("x_o", "y_o")).alias("need")).filter("k >= need").select("a", "b")

    lists = main_cells(bare, ["ref"], "group").drop("rows")
    near = bare.filter(100 * F.col("o") >= percent * F.col("size")).join(small_side(lists, BROADCAST_ROWS // 2), "ref")
    x = near.filter(F.col("group") != F.col("main")).withColumn("least", F.expr(f"({percent} * size + 99) div 100")).withColumn("most", F.expr(f"(o * {100 + percent}) div {percent} - size"))
    x = x.filter("least <= most").select("ref", F.explode(F.sequence("least", "most")).alias("y_size"), *(F.col(c).alias(f"x_{c}") for c in ("id", "group", "size", "o")))
    y = near.select("ref", F.col("size").alias("y_size"), *(F.col(c).alias(f"y_{c}") for c in ("id", "group", "o", "main")))
    once = (F.col("y_group") == F.col("y_main")) | (F.col("x_id") < F.col("y_id"))
    second = x.join(y, ["ref", "y_size"]).filter(once & (F.col("x_group") != F.col("y_group")) & (F.least("x_o", "y_o") >= need)).select(*pair)
    return first.unionByName(second)


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id reachable by links, its own included).

    Documents with equal sets are one class, joined by its least id. Among
    classes, three passes lose no link and don't list all pairs of a group:
    1. each document is compared with the head it shares most prefix
       shingles with, which ties near copies together;
    2. documents of long lists that still hold several groups are compared
       with the centre of the group that they meet most (`references`), which
       then stands for what most of them hold besides (`widened`); two
       with one centre need a comparison only as `by_reference` says;
    3. in each list, documents of different groups and centres are compared
       if they have enough matches.
    Pairs inside a group need no comparison. What remains quadratic is the
    number of documents of different groups that share a rare shingle, or one
    that their common centre lacks and at most half of its documents hold.

    Null and empty texts have no shingles and no links. Ids name documents:
    rows under one id should have one text, and repeated rows share a verdict;
    null ids are returned without a class. No candidate is capped. An empty
    table gives an empty result. Other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with small_batches(df.sparkSession):
        seen = checkpointed(profile(rows, n))
    sets = seen.filter(F.col("size").isNotNull())
    tallied = seen.filter(F.col("size").isNull()).groupBy("id").agg(F.sum("h1").alias("k")).filter("k >= 8")
    top = tallied.orderBy(F.desc("k"), "id").limit(FREQUENT).toPandas().sort_values("id", key=lambda x: x.to_numpy().view(np.uint64))
    frequent = top["id"].to_numpy(np.int64).view(np.uint64), top["k"].to_numpy(np.int64)

    classes = checkpointed(sets.filter("size > 0").groupBy("h1", "h2", "size").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"))
    member = checkpointed(sets.join(small_side(classes, BROADCAST_ROWS // 2), ["h1", "h2", "size"], "left").select("id", "size", F.coalesce("rep", "id").alias("rep")))
    copies = checkpointed(member.filter("id <> rep").select("id").distinct())
    single = rows.join(small_side(copies), "id", "left_anti").filter(F.col("id").isNotNull())

    with small_batches(df.sparkSession):
        shared = checkpointed(shared_postings(prefixes(single, frequent, n, percent)))
    near = shared.filter((F.col("id") != F.col("head")) & fitting("size", "head_size", percent)).groupBy("id", "head").agg(F.count(F.lit(1)).alias("k"))
    stars = near.groupBy("id").agg(F.max_by("head", F.struct("k", -F.col("head"))).alias("head")).select(F.col("head").alias("a"), F.col("id").alias("b"))
    ties = checkpointed(compared(checkpointed(stars), single, n).filter(similar(percent)).select("a", "b"))
    first = connected_components(ties)
    lists = shared.select("shingle", "id", "size", "level", "need")

    named = checkpointed(grouped(lists, first))
    ties = ties.join(first, ties["a"] == first["node"]).select("a", F.col("component").alias("group"))
    refs = checkpointed(references(named, ties))
    seen_by = checkpointed(compared(refs.filter("a <> b"), single, n, rest=True))
    second = connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(seen_by.filter(similar(percent)).select("a", "b")))
    self = refs.filter("a = b").join(member.filter("id = rep").distinct(), F.col("id") == F.col("a")).select("a", "b", F.col("size").cast("long").alias("size"), F.col("size").cast("long").alias("o"), F.array().cast("array<long>").alias("rest"))
    known = seen_by.filter("2 * common >= size_b").select("a", "b", F.col("size_b").alias("size"), F.col("common").alias("o"), "rest").unionByName(self)
    known = checkpointed(widened(grouped(known.select(F.col("b").alias("id"), F.col("a").alias("ref"), "size", "o", "rest"), second)))

    pair = [F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")]
    placed = grouped(lists, second).join(small_side(known.select("id", "ref")), "id", "left")
    placed = checkpointed(placed.withColumn("cell", F.struct(F.col("ref").isNull().alias("alone"), F.coalesce("ref", "group").alias("of"))).drop("ref"))
    need = F.least("x_need", "y_need")
    meet = (F.col("x_group") != F.col("y_group")) & fitting("x_size", "y_size", percent) & (F.greatest("x_level", "y_level") <= need)
    matches = across(placed, ["shingle"], "cell", meet)
    pairs = matches.groupBy(*pair).agg(F.count(F.lit(1)).alias("k"), F.first(need + spare("x_size", "y_size", percent)).alias("need")).filter("k >= need").select("a", "b")
    pairs = checkpointed(pairs.unionByName(by_reference(known, percent)).distinct())
    links = compared(pairs, single, n).filter(similar(percent)).select("a", "b")
    final = checkpointed(connected_components(second.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)))

    out = member.join(small_side(final.withColumnRenamed("node", "rep")), "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` whose id is the least of their component, with all their columns; rows without an id stay."""
    classes = ngram_join(df, id_col, text_col)
    gone = checkpointed(classes.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct())
    return df.join(small_side(gone), df[id_col] == F.col("__gone"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents"))
