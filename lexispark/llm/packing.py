"""Packing of token ids into windows by minimum bin slack over a histogram of lengths."""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.runtime import checkpointed, read_table, small_batches

from .text import held, let_go, slices

WINDOW, END = 4096, 2
#: Words whose ids a worker remembers; older ones are encoded again.
MEMORY = 400_000
_MARK = "`"
#: Punctuation that ends a run of letters wherever it stands; an apostrophe may be part of a contraction.
_TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_{|}~"
#: Byte-level BPE writes a byte as a character: printable ones as themselves, the others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _ends_in_letter(core: bytes) -> bool:
    """Whether the tokenizer sees a letter last: it composes and lowers a text before it cuts, and both may put a mark there."""
    if not core or core[-1] < 128:
        return core[-1:].isalpha()
    text = core.decode("utf-8", "replace")
    return all(x[-1:].isalpha() for x in (text, unicodedata.normalize("NFC", text), unicodedata.normalize("NFC", text).lower(), unicodedata.normalize("NFC", text.lower())))


class WordEncoder:
    """Ids of whole texts from those of their words.

    The tokenizer drops white space and never joins pieces across it, so a
    text's ids are its words' ids in order. Unknown words are encoded many to
    a call, apart by a mark; words that hold the mark are encoded alone. A
    word of letters and closing punctuation is two pieces to the tokenizer,
    so the two are looked up apart, and letters go to its model directly.

    With `special` a special token that a text spells out is that token, as
    the library has it by default; a word that holds one is encoded alone.
    Without, its characters are text like any other.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of its own hold memory each
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {b"": b""}
        ids = self._ids(f"a {_MARK} a")
        self.mark = ids[len(ids) // 2]
        if self._ids(_MARK) != [self.mark]:
            raise ValueError("the mark is no token of its own")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _spelt(self, text: bytes) -> bool:
        return any(s in text for s in self.special)

    def _lowered(self, text: bytes) -> bytes:
        """ASCII in lower case, so that fewer words differ; but a special token counts only as it is spelt."""
        low = text.lower() if text.isascii() else text
        return text if self._spelt(low) else low

    def _letters(self, text: str) -> bytes | None:
        """Ids of a run of letters straight from the model, which is what the whole chain comes to; None for any other text."""
        if not text.isalpha() or not (ascii_ := text.isascii()) and not unicodedata.is_normalized("NFC", text):
            return None
        text = text.lower()
        if not ascii_:
            if not text.isalpha() or "\u03c2" in text:  # lower case may add marks, and picks the last sigma by its place
                return None
            text = text.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        parts, whole = {}, []
        special = self._spelt(b" ".join(words))  # hardly ever, so each word is asked only then
        for w in words:
            core = w.rstrip(_TAIL)
            if len(core) < len(w) and _ends_in_letter(core) and not (special and self._spelt(w)):
                parts[w] = core, w[len(core) :]
            else:
                whole.append(w)
        new = dict.fromkeys(chain(whole, (x for both in parts.values() for x in both if x not in self.known)))
        rest = []
        for w in new:
            ids = self._letters(w.decode("utf-8", "replace"))
            if ids is None:
                rest.append(w)
            else:
                self.known[w] = ids
        self._learn_whole(rest)
        for w, (core, tail) in parts.items():
            self.known[w] = self.known[core] + self.known[tail]

    def _learn_whole(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [k for k, t in enumerate(texts) if _MARK not in t and (t.isascii() or _MARK not in unicodedata.normalize("NFC", t)) and not self._spelt(words[k])]
        for k in set(range(len(texts))) - set(plain):
            self.known[words[k]] = np.array(self._ids(texts[k]), "<u4").tobytes()
        groups = [plain[k : k + 256] for k in range(0, len(plain), 256)]
        for at in range(0, len(groups), 64):
            some = groups[at : at + 64]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([f" {_MARK} ".join(texts[k] for k in g) for g in some], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                parts = np.split(ids, np.flatnonzero(ids == self.mark))
                if len(parts) != len(group):  # the mark got into another token
                    for k in group:
                        self.known[words[k]] = np.array(self._ids(texts[k]), "<u4").tobytes()
                    continue
                for j, (k, x) in enumerate(zip(group, parts)):
                    self.known[words[k]] = (x[1:] if j else x).tobytes()

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = pc.ascii_split_whitespace(pa.array([self._lowered(t) for t in texts], pa.large_binary()).view(pa.large_string()))
        if len(self.known) > MEMORY:
            for w in list(islice(self.known, len(self.known) - MEMORY // 2)):
                del self.known[w]
            self.known[b""] = b""
        words = split.flatten().dictionary_encode()
        used = words.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        self._learn([w for w in used if w not in self.known])
        ids = pa.array([self.known[w] for w in used], pa.large_binary()).take(words.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1][split.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(at[:-1], at[1:])]


def best_fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """Lengths and how many of each come closest to `capacity` without exceeding it.

    Bit s of the set is on if some of the lengths add up to s. A length
    with a count enters in parts of 1, 2, 4, ... copies. The search ends when the
    capacity is reached; the sets before each part lead back to the counts.
    """
    room, reach, trail = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:
            part = min(part, left)
            trail.append((length, part, reach))
            reach |= (reach << (length * part)) & room
            left, part = left - part, part * 2
        if reach >> capacity:
            break
    total, out = reach.bit_length() - 1, {}
    for length, part, before in reversed(trail):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + part
            total -= length * part
    return sorted(out.items(), reverse=True)


def plan_windows(counts: dict[int, int], capacity: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies)]) for all lengths of the histogram.

    Each filling holds the longest length that is left and is used as often as
    the counts allow, so the work depends on how many different lengths there
    are (`capacity` at most), not on how many pieces.
    """
    counts, plan = {k: n for k, n in counts.items() if n > 0}, []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        fill = dict(best_fill({k: n for k, n in rest.items() if n}, capacity - longest))
        fill[longest] = fill.get(longest, 0) + 1
        times = min(counts[k] // m for k, m in fill.items())
        plan.append((times, sorted(fill.items(), reverse=True)))
        for k, m in fill.items():
            counts[k] -= times * m
            if not counts[k]:
                del counts[k]
    return plan


def cut_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = WINDOW, with_ids: bool = False, special: bool = True) -> DataFrame:
    """Encode each text, append the end id, and cut at multiples of `capacity`.

    Also numbers the pieces of each length within their partition (part, local).
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        from pyspark import TaskContext

        let_go(keep=("words", tokenizer, special))
        part = TaskContext.get().partitionId()
        encoder, seen = worker_encoder(tokenizer, special), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                out = []
                for doc, ids in zip(piece.column(0).to_pylist(), encoder(piece.column(1).to_pylist())):
                    ids += END.to_bytes(4, "little")
                    for at in range(0, len(ids), 4 * capacity):
                        x = ids[at : at + 4 * capacity]
                        out.append((doc, at // 4, len(x) // 4, zlib.crc32(x), len(ids) // 4, x if with_ids else None))
                length = np.array([x[2] for x in out])
                order = np.argsort(length, kind="stable")
                first = np.flatnonzero(np.diff(length[order], prepend=-1))
                local = np.empty(len(out), np.int64)
                local[order] = np.arange(len(out)) - np.repeat(first, np.diff(np.append(first, len(out)))) + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary()), pa.array(np.full(len(out), part), pa.int64()), pa.array(local, pa.int64())], ["id", "start", "length", "ids_crc32", "doc_tokens", "ids", "part", "local"])

    return rows.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, part long, local long")


def worker_encoder(path: str, special: bool = True) -> WordEncoder:
    return held(("words", path, special), lambda: WordEncoder(path, special))


def pack(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = WINDOW, with_ids: bool = False, special: bool = True) -> DataFrame:
    """Pack the tokens of all rows into sequences of at most `capacity` ids.

    One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and ids (little-endian unsigned 32-bit) if asked for. `special`
    tells whether special tokens spelt out in a text are read as such. Texts are
    cut at multiples of the capacity; the histogram of the lengths, which has
    `capacity` entries at most, is planned on the driver, and each piece finds
    its place by its rank among the pieces of its length. Null and empty
    texts are the end id alone. Rows that repeat, or share an id, are packed
    each. An empty table gives no pieces. Other columns are not read.
    """
    pieces = cut_pieces(df, tokenizer or public_tokenizers.path("word_bpe_49k.json"), id_col, text_col, capacity, with_ids, special)
    with small_batches(df.sparkSession):
        pieces = checkpointed(pieces if with_ids else pieces.drop("ids"))
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    before = by_part.select("part", "length", earlier.alias("before"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    rows, sequence, taken = [], 0, dict.fromkeys(counts, 0)
    for times, fill in plan_windows(counts, capacity):
        at = 0
        for length, copies in fill:
            rows.append((length, taken[length], copies, sequence, at))
            taken[length] += times * copies
            at += length * copies
        sequence += times
    places = np.array(sorted(rows), np.int64).reshape(-1, 5)
    keys = (places[:, 0] << 48) | places[:, 1]

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("before").to_numpy() + b.column("local").to_numpy()
            _, first, copies, seq, at = places[np.searchsorted(keys, (length << 48) | rank, "right") - 1].T
            turn, copy = np.divmod(rank - first, copies)
            kept = [c for c in b.schema.names if c not in ("part", "local", "before")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(seq + turn), pa.array(at + copy * length)], [*kept, "sequence_id", "offset"])

    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    ready = pieces.join(before, ["part", "length"]).select("id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, "part", "local", "before")
    return ready.mapInArrow(place, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
