"""Language-model scoring by a sharded Elias-Fano trie of n-grams up to three words."""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.runtime import checkpointed, read_table

from .elias_fano import EliasFano, encode
from .text import let_go, slices, word_hashes, words

#: The end of a text as a token (an empty word, which no text holds).
END = b""
#: Absolute discount, and how often an n-gram of two or three words must occur to be held: by default all are.
DISCOUNT, LEAST = 0.6, 1
#: Tokens that a task counts before it passes the counts on; levels that a worker holds if it can't map their files; shards to an input partition.
FLUSH, OPEN, SHARDS = 2 << 20, 64, 4
#: Bytes of numbered texts (four a token) that are looked up together: each shard is visited once for them.
SLICE = 4 << 20


# ---- files of the model, in the folder that driver and executors share ----


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def is_local(root: str) -> bool:
    """Whether the folder is mounted, so that files are mapped and their pages come and go."""
    from pyarrow import fs

    return isinstance(_store(root)[0], fs.LocalFileSystem)


def write_level(root: str, name: str, arrays: dict[str, np.ndarray], **facts) -> None:
    """One file: a JSON header, then the arrays, each at a multiple of 64 bytes. Appears whole or not at all."""
    store, path = _store(root)
    store.create_dir(path, recursive=True)
    at, head = 0, {}
    for k, x in arrays.items():
        head[k] = [x.dtype.str, x.shape, at]
        at += -(-x.nbytes // 64) * 64
    text = json.dumps({"arrays": head, "facts": facts}).encode()
    text = text.ljust(-(-(len(text) + 8) // 64) * 64 - 8)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for x in arrays.values():
            out.write(np.ascontiguousarray(x).tobytes() + b"\0" * (-x.nbytes % 64))
    store.move(part, f"{path}/{name}")


def read_level(root: str, name: str) -> tuple[dict[str, np.ndarray], dict]:
    """Arrays mapped from the file where the folder is mounted, else read through its file system."""
    from pyarrow import fs

    store, path = _store(root)
    local = isinstance(store, fs.LocalFileSystem)
    with store.open_input_file(f"{path}/{name}") as f:
        data = None if local else np.frombuffer(f.read(), np.uint8)
        size = int.from_bytes(f.read(8) if local else data[:8].tobytes(), "little")
        head = json.loads(f.read(size) if local else data[8 : 8 + size].tobytes())
    if local:
        data = np.asarray(np.memmap(f"{path}/{name}", np.uint8, "r"))  # slices of a plain array are cheaper
    out = {}
    for k, (kind, shape, at) in head["arrays"].items():
        kind = np.dtype(kind)
        begin = 8 + size + at
        out[k] = data[begin : begin + kind.itemsize * int(np.prod(shape))].view(kind).reshape(shape)
    return out, head["facts"]


# ---- quantised values ----


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and the mean of each code's values; codes hold about as many values each."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(1)
    cuts = np.unique(np.quantile(x, np.arange(1, 256) / 256))
    codes = np.searchsorted(cuts, x, "left").astype(np.uint8)
    size = np.bincount(codes, minlength=256)
    return codes, np.bincount(codes, weights=x, minlength=256) / np.maximum(size, 1)


class Trie:
    """Lookups in the levels that exist so far; shards are opened when first needed.

    Words are numbered by the order of their hashes; shard s holds the words
    from base[s] on, and the n-grams that begin with them.
    """

    def __init__(self, root: str, facts: dict):
        self.root, self.base = root, np.array(facts["base"], np.int64)
        self.tokens, self.types = facts["tokens"], facts["types"]
        self.nodes, self.width = np.array(facts.get("nodes", [0]), np.int64), facts.get("width", 1)
        if self.types >= 2**32 - 1 or int(self.nodes[-1]) * self.width >= 2**63:
            raise OverflowError(f"{self.types} words and {self.nodes[-1]} pairs don't fit the keys of 64 bits")
        self.open: OrderedDict[str, tuple] = OrderedDict()
        self.mapped = is_local(root)

    def level(self, kind: str, s: int) -> tuple[dict, dict]:
        key = f"{kind}-{s}"
        if key in self.open:
            self.open.move_to_end(key)
        else:
            while not self.mapped and len(self.open) >= OPEN:
                self.open.popitem(last=False)
            arrays, facts = read_level(self.root, key)
            for name in facts.get("sequences", ()):
                arrays[name] = EliasFano({k: arrays[f"{name}.{k}"] for k in ("low", "high", "ones", "shape")})
            self.open[key] = arrays, facts
        return self.open[key]

    def by_shard(self, owner: np.ndarray):
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(len(self.base)))
        for s in range(len(self.base) - 1):
            if cut[s] < cut[s + 1]:
                yield s, order[cut[s] : cut[s + 1]]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words; -1 for those without."""
        out = np.full(len(hashes), -1, np.int64)
        for s, rows in self.by_shard(shard_of(hashes, len(self.base) - 1)):
            known = self.level("words", s)[0]["hash"]
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[rows]), len(known) - 1)
                out[rows] = np.where(known[at] == hashes[rows], at + self.base[s], -1)
        return out

    def owner(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < 0, -1, np.searchsorted(self.base, ids, "right") - 1)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        for s, rows in self.by_shard(self.owner(ids)):
            out[rows] = self.level("words", s)[0]["count"][ids[rows] - self.base[s]]
        return out

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        """log10 of (count + 1) / (tokens + types + 1)."""
        return np.log10((self.counts(ids) + 1) / (self.tokens + self.types + 1))

    def bigrams(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node of each pair (-1: none), and its place among the successors of the first word."""
        node, place = np.full(len(first), -1, np.int64), np.zeros(len(first), np.int64)
        for s, rows in self.by_shard(np.where(second < 0, -1, self.owner(first))):
            a = self.level("pairs", s)[0]
            begin = first[rows] - self.base[s]
            at, hit = a["key"].successor((begin * self.types + second[rows]).astype(np.uint64))
            node[rows[hit]] = at[hit] + self.nodes[s]
            place[rows[hit]] = at[hit] - a["begin"].access(begin[hit]).astype(np.int64)
        return node, place

    def trigrams(self, node: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the trie has the third word, by its place among the successors of the second, and its log10 probability."""
        found, value = np.zeros(len(node), bool), np.zeros(len(node))
        for s, rows in self.by_shard(np.where(node < 0, -1, np.searchsorted(self.nodes, node, "right") - 1)):
            a = self.level("triples", s)[0]
            at, hit = a["key"].successor(((node[rows] - self.nodes[s]) * self.width + place[rows]).astype(np.uint64))
            found[rows[hit]] = True
            value[rows[hit]] = a["book"][a["code"][at[hit]]]
        return found, value

    def at_nodes(self, node: np.ndarray, code: str, book: str) -> np.ndarray:
        out = np.zeros(len(node))
        for s, rows in self.by_shard(np.where(node < 0, -1, np.searchsorted(self.nodes, node, "right") - 1)):
            a = self.level("pairs" if code == "code" else "triples", s)[0]
            out[rows] = a[book][a[code][node[rows] - self.nodes[s]]]
        return out

    def backoff(self, ids: np.ndarray) -> np.ndarray:
        """log10 of what is left to shorter n-grams after each word; 0 after unknown ones."""
        out = np.zeros(len(ids))
        for s, rows in self.by_shard(self.owner(ids)):
            a = self.level("pairs", s)[0]
            out[rows] = a["back_book"][a["back"][ids[rows] - self.base[s]]]
        return out


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


_TRIES: OrderedDict[tuple, Trie] = OrderedDict()


def worker_trie(root: str, facts: dict) -> Trie:
    key = root, len(facts)
    if key not in _TRIES:
        while len(_TRIES) > 2:
            _TRIES.popitem(last=False)
        _TRIES[key] = Trie(root, facts)
    return _TRIES[key]


# ---- counting: sorted keys and counts in one row for each task and shard ----

_BLOB = "shard int, first binary, steps binary, width int, counts binary, count_width int"


def _blobs(keys: np.ndarray, counts: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    """Keys (sorted) as steps from each to the next, in the narrowest type that holds them."""
    rows, cut = [], np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
    for a, b in zip(cut[:-1], cut[1:]):
        steps, n = np.diff(keys[a:b]), counts[a:b]
        kind = next(k for k in ("u4", "u8") if not len(steps) or steps.max() < 2 ** (8 * int(k[1])))
        size = next(k for k in ("u1", "u4", "u8") if n.max() < 2 ** (8 * int(k[1])))
        rows.append((int(owner[a]), keys[a].tobytes(), steps.astype(kind).tobytes(), int(kind[1]), n.astype(size).tobytes(), int(size[1])))
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["shard", "first", "steps", "width", "counts", "count_width"])


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for r in table.to_pylist():
        steps = np.frombuffer(r["steps"], f"u{r['width']}").astype(np.uint64)
        keys.append(np.cumsum(np.append(np.frombuffer(r["first"], np.uint64), steps), dtype=np.uint64))
        counts.append(np.frombuffer(r["counts"], f"u{r['count_width']}").astype(np.int64))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[new], np.add.reduceat(counts[order], new)


def _counted(parts, owner_of):
    """Blobs from arrays of keys, a flush at a time."""
    held, amount = [], 0
    for keys in chain(parts, [None]):
        if keys is not None:
            held.append(keys)
            amount += len(keys)
        if amount and (keys is None or amount >= FLUSH):
            x, n = np.unique(np.concatenate(held), return_counts=True)
            yield _blobs(x, n, owner_of(x))
            held, amount = [], 0


def _reduced(blobs: DataFrame, build) -> list:
    """Build each shard's level from its merged counts; rows of facts by shard."""

    def run(table: pa.Table) -> pa.Table:
        let_go()
        shard = table["shard"][0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int32()), "facts": [json.dumps(build(shard, *_merged(table)))]})

    return [(r["shard"], json.loads(r["facts"])) for r in blobs.groupBy("shard").applyInArrow(run, "shard int, facts string").collect()]


def _empty(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(n, np.uint64), np.zeros(n, np.int64)


def _sequences(**named) -> tuple[dict[str, np.ndarray], list[str]]:
    return {f"{k}.{part}": x for k, (values, universe) in named.items() for part, x in encode(values, universe).items()}, list(named)


# ---- the model ----


def learn_words(texts: DataFrame, root: str, shards: int) -> dict:
    def count(batches):
        def parts():
            for batch in batches:
                for part in slices(batch, "text"):
                    split = [words(t) for t in part.column("text").to_pylist()]
                    yield word_hashes([*chain.from_iterable(split), *[END] * len(split)])

        yield from _counted(parts(), lambda x: shard_of(x, shards))

    def build(s, keys, counts):
        write_level(root, f"words-{s}", {"hash": keys, "count": counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.uint64)})
        return [len(keys), int(counts.sum())]

    found = dict(_reduced(texts.mapInArrow(count, _BLOB), build))
    for s in set(range(shards)) - set(found):
        build(s, *_empty(0))
    sizes = [found.get(s, [0, 0]) for s in range(shards)]
    return {"base": [0, *np.cumsum([x[0] for x in sizes]).tolist()], "types": sum(x[0] for x in sizes), "tokens": sum(x[1] for x in sizes)}


def learn_pairs(ids: DataFrame, root: str, facts: dict, least: int = LEAST) -> dict:
    """Pairs that occur `least` times: keys, smoothed probabilities, and what each first word leaves to single words."""
    shards = len(facts["base"]) - 1

    def count(batches):
        trie = worker_trie(root, facts)

        def parts():
            for flat, start in sequences_of(batches, trie):
                inner = ~start
                yield (flat[:-1][inner[1:]] * trie.types + flat[1:][inner[1:]]).astype(np.uint64)

        yield from _counted(parts(), lambda x: trie.owner((x // np.uint64(trie.types)).astype(np.int64)))

    def build(s, keys, counts):
        trie = worker_trie(root, facts)
        keys, counts = keys[counts >= least], counts[counts >= least]
        n, base = int(trie.base[s + 1] - trie.base[s]), int(trie.base[s])
        own = keys - np.uint64(base * trie.types)
        first, second = (own // np.uint64(max(1, trie.types))).astype(np.int64), (keys % np.uint64(max(1, trie.types))).astype(np.int64)
        total = np.maximum(trie.counts(np.arange(base, base + n)), 1)
        left = 1 - np.bincount(first, weights=counts - DISCOUNT, minlength=n) / total
        left = np.maximum(left, 1e-6)
        p = (counts - DISCOUNT) / total[first] + left[first] * 10 ** trie.unigram(second)
        code, book = quantised(np.log10(p))
        back, back_book = quantised(np.log10(left))
        begin = np.searchsorted(first, np.arange(n + 1))
        arrays, names = _sequences(key=(own, max(1, n * trie.types)), begin=(begin, len(keys) + 1))
        write_level(root, f"pairs-{s}", {**arrays, "code": code, "book": book, "back": back, "back_book": back_book, "count": counts.astype(np.uint32)}, sequences=names)
        return [len(keys), int(np.diff(begin).max(initial=0))]

    found = dict(_reduced(ids.mapInArrow(count, _BLOB), build))
    for s in set(range(shards)) - set(found):
        build(s, *_empty(0))
    sizes = [found.get(s, [0, 0]) for s in range(shards)]
    return {**facts, "nodes": [0, *np.cumsum([x[0] for x in sizes]).tolist()], "width": max(x[1] for x in sizes) + 1}


def learn_triples(ids: DataFrame, root: str, facts: dict, least: int = LEAST) -> dict:
    """Triples that occur `least` times; both of their pairs then do, so only such triples are counted.

    The third word is held as its place among the successors of the second.
    """
    shards = len(facts["base"]) - 1

    def count(batches):
        trie = worker_trie(root, facts)

        def parts():
            for flat, start in sequences_of(batches, trie):
                node, place = pair_nodes(flat, start, trie)
                both = (node[:-1] >= 0) & (node[1:] >= 0) & ~start[1:-1] & ~start[2:] if len(flat) > 2 else np.zeros(0, bool)
                yield (node[:-1][both] * trie.width + place[1:][both]).astype(np.uint64)

        yield from _counted(parts(), lambda x: np.searchsorted(trie.nodes, (x // np.uint64(trie.width)).astype(np.int64), "right") - 1)

    def build(s, keys, counts):
        trie = worker_trie(root, facts)
        keys, counts = keys[counts >= least], counts[counts >= least]
        n = int(trie.nodes[s + 1] - trie.nodes[s])
        own = keys - np.uint64(int(trie.nodes[s]) * trie.width)
        parent, place = (own // np.uint64(trie.width)).astype(np.int64), (own % np.uint64(trie.width)).astype(np.int64)
        pairs = trie.level("pairs", s)[0]
        total = np.maximum(pairs["count"].astype(np.float64), 1)
        left = np.maximum(1 - np.bincount(parent, weights=counts - DISCOUNT, minlength=n) / total, 1e-6)
        middle = (pairs["key"].access(parent) % np.uint64(trie.types)).astype(np.int64)
        shorter = np.zeros(len(own))
        for k, rows in trie.by_shard(trie.owner(middle)):
            a = trie.level("pairs", k)[0]
            at = a["begin"].access(middle[rows] - trie.base[k]).astype(np.int64) + place[rows]
            shorter[rows] = a["book"][a["code"][at]]
        code, book = quantised(np.log10((counts - DISCOUNT) / total[parent] + left[parent] * 10**shorter))
        back, back_book = quantised(np.log10(left))
        arrays, names = _sequences(key=(own, max(1, n * trie.width)), begin=(np.searchsorted(parent, np.arange(n + 1)), len(keys) + 1))
        write_level(root, f"triples-{s}", {**arrays, "code": code, "book": book, "back": back, "back_book": back_book}, sequences=names)
        return [len(keys)]

    found = dict(_reduced(ids.mapInArrow(count, _BLOB), build))
    for s in set(range(shards)) - set(found):
        build(s, *_empty(0))
    return {**facts, "triples": sum(x[0] for x in found.values())}


def sequences_of(batches, trie: Trie):
    """Words of many texts in a row, with an end before each and after the last; start marks the ends that begin a text.

    Unknown words are -1. A text's context begins anew at its first end.
    """
    end = trie.ids(word_hashes([END]))[0]
    for batch in batches:
        for part in slices(batch, "ids", SLICE):
            flat, starts = [], []
            for x in part.column("ids").to_pylist():
                ids = np.frombuffer(x, "<u4").astype(np.int64) - 1
                flat += [np.array([end]), ids]
                starts.append(1 + len(ids))
            start = np.zeros(sum(starts), bool)
            start[np.cumsum([0, *starts[:-1]])] = True
            yield np.concatenate(flat), start


def pair_nodes(flat: np.ndarray, start: np.ndarray, trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """Node and place of each pair of neighbours; different pairs are looked up once."""
    wide = trie.types + 1
    key = np.where(start[1:], -1, (flat[:-1] + 1) * wide + flat[1:] + 1)
    unique, back = np.unique(key, return_inverse=True)
    first, second = np.where(unique < 0, -1, unique // wide - 1), unique % wide - 1
    node, place = trie.bigrams(first, second)
    return node[back], place[back]


def log_probabilities(flat: np.ndarray, start: np.ndarray, trie: Trie) -> np.ndarray:
    """log10 probability of each token after the two before it; 0 at starts."""
    node, place = pair_nodes(flat, start, trie)
    words_, back = np.unique(flat, return_inverse=True)
    single, left = trie.unigram(words_)[back], trie.backoff(words_)[back]
    out = np.zeros(len(flat))
    out[1:] = np.where(node >= 0, 0, left[:-1] + single[1:])
    known = np.flatnonzero(node >= 0)
    nodes, where = np.unique(node[known], return_inverse=True)
    out[known + 1] = trie.at_nodes(nodes, "code", "book")[where]
    before = node[:-1]  # the pair that ends where the next one begins
    after = np.flatnonzero((before >= 0) & ~start[2:])
    if len(after):
        contexts, where = np.unique(before[after], return_inverse=True)
        rest = trie.at_nodes(contexts, "back", "back_book")[where]
        found, value = trie.trigrams(np.where(node[1:][after] >= 0, before[after], -1), place[1:][after])
        out[after + 2] = np.where(found, value, rest + out[after + 2])
    out[start] = 0
    return out


def score_texts(df: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per input row: id, learned, n_tokens, n_known, train_tokens, base_score, score.

    `learn` is a condition on `df`: its rows train the model. Tokens are words
    (A-Z lowered) and an end for each text. base_score adds up log10 of
    (count+1)/(tokens+types+1); score is by the trie: interpolated absolute
    discounting over pairs and triples that occur `least` times or more (1 keeps all), 8-bit values.

    Training passes: words are counted and numbered; all texts become numbers
    (a table in the checkpoint folder); pairs, then triples, are counted. Each
    task sends one compact row for a shard, already summed, so a frequent word costs
    one entry a task. A shard is a range of first words by hash, and there are four
    to an input partition, so what one holds doesn't grow with the input but for
    the successors of its most frequent word, at most as many as there are words. Levels are
    files in the checkpoint folder, mapped by the workers; where that is an
    object store, a worker holds the last `OPEN` that it used. Keys that 64 bits can't
    hold raise an error.

    Null and empty texts are an end alone. If no row trains, every token is
    unknown. Repeated rows count and are scored each. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learned"))
    shards = SHARDS * max(1, rows.rdd.getNumPartitions())
    checkpointed(spark.range(0))  # makes sure of the folder
    root = f"{spark.sparkContext.getCheckpointDir()}/ngrams-{uuid.uuid4().hex}"
    facts = learn_words(rows.filter("learned").select("text"), root, shards)
    first = dict(facts)

    def number(batches):
        trie = worker_trie(root, first)
        for batch in batches:
            for part in slices(batch, "text"):
                split = [[*words(t), END] for t in part.column("text").to_pylist()]
                unique, back = np.unique(word_hashes(list(chain.from_iterable(split))), return_inverse=True)
                ids = (trie.ids(unique) + 1).astype("<u4")[back]
                ends = np.cumsum([len(x) for x in split])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("learned"), pa.array([x.tobytes() for x in np.split(ids, ends[:-1])], pa.binary())], ["id", "learned", "ids"])

    path = f"{root}/ids"
    rows.mapInArrow(number, "id long, learned boolean, ids binary").write.parquet(path)
    ids = spark.read.schema("id long, learned boolean, ids binary").parquet(path)
    known = ids.filter("learned").select("ids")
    pairs = learn_pairs(known, root, first, least) if facts["types"] else facts
    model = learn_triples(known, root, pairs, least) if facts["types"] else facts

    def score(batches):
        trie = worker_trie(root, model)
        for batch in batches:
            for part in slices(batch, "ids", SLICE):
                (flat, start), = sequences_of([part], trie)
                texts = np.cumsum(start) - 1
                n = int(start.sum())
                unique, back = np.unique(flat, return_inverse=True)
                base, seen = trie.unigram(unique)[back], (trie.counts(unique) > 0)[back]
                value = log_probabilities(flat, start, trie) if trie.types else np.where(start, 0, base)
                add = lambda x: np.bincount(texts, weights=np.where(start, 0, x), minlength=n)  # noqa: B023, E731
                tokens = np.bincount(texts, minlength=n) - 1
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("learned"), pa.array(tokens), pa.array(add(seen).astype(np.int64)), pa.array(np.full(n, trie.tokens)), pa.array(add(base)), pa.array(add(value))], ["id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scored = ids.mapInArrow(score, "id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.crc32(F.col("doc_id").cast("string")) % 7
    scored = score_texts(read_table(spark, sf_dir, "documents"), part != 2, least=1)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
