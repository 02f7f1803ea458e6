"""Secret scans: fixed patterns, and sliding-window entropy by character class. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.runtime import read_table

#: Kind: pattern, group whose length counts, least length. Kinds are listed in the order that breaks ties.
BASE_KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Class of a candidate: all of its characters, least entropy in bits of a window. The first that fits counts.
ENTROPY_KINDS = {"entropy_hex": (r"^[0-9a-f]+$", 2.9), "entropy_upper": (r"^[A-Z0-9]+$", 3.3), "entropy_mixed": (r"^[A-Za-z0-9+/_=-]+$", 3.6)}
#: Codes of the first and last character of a candidate; counts in a long; units of a bit of entropy.
FIRST, LAST, PACKED, UNIT = ord("+"), ord("z"), 12, 1 << 40
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: What is no secret wherever it stands in a candidate (examples, runs of the alphabet, one character repeated), and as a whole: UUIDs.
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|0123456789|abcdefghij|(.)\1{9,}"
ALLOWED_WHOLE = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
SPAN = "array<struct<start:int,ord:int,kind:string,end:int>>"


def bound(x: Column, then) -> Column:
    """`then` of a value that is worked out once, not wherever it is named."""
    return F.element_at(F.transform(F.array(x), then), 1)


def running(xs: Column, combine, chunk: int = 256) -> Column:
    """Running values (sum, max, ...) of an array of ints, from 0; each chunk is folded by itself, so a long array isn't copied at every step."""
    zero = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out"))
    both = F.struct(F.lit(0).alias("last"), F.array().cast("array<array<int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        now = combine(acc["last"], x)
        return F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

    def outer(acc: Column, c: Column) -> Column:
        moved = F.transform(c["out"], lambda v: combine(acc["last"], v))
        return F.struct(combine(acc["last"], c["last"]).alias("last"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def chunks(all_: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_) / chunk).cast("int") - 1, F.lit(0)))
        folded = F.transform(starts, lambda k: F.aggregate(F.slice(all_, k * chunk + 1, F.lit(chunk)), zero, step))
        return F.flatten(F.aggregate(folded, both, outer)["out"])

    return bound(xs, chunks)


def between(text: Column, pattern: str) -> Column:
    """Matches and what lies before each: array of (gap, hit, to), `to` being where the match ends; the last has no match.

    Positions, in code points, come from the lengths of what lies between the matches.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def ends(all_: Column) -> Column:
        sizes = F.transform(all_, lambda x: F.char_length(x["gap"]) + F.coalesce(F.char_length(x["hit"]), F.lit(0)))
        return F.zip_with(all_, running(sizes, lambda a, b: a + b), lambda x, to: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), to.alias("to")))

    return bound(parts, ends)


def located(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap: array of (start, end, hit) in code points."""
    hits = F.filter(between(text, pattern), lambda x: x["hit"].isNotNull())
    found = F.transform(hits, lambda x: F.struct((x["to"] - F.char_length(x["hit"])).alias("start"), x["to"].alias("end"), x["hit"].alias("hit")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string>>"))


def pattern_spans(text: Column, k: int, kind: str) -> Column:
    pattern, group, least = BASE_KINDS[kind]
    hits = F.filter(located(text, pattern), lambda x: F.char_length(F.regexp_extract(x["hit"], pattern, group)) >= least)
    return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("ord"), F.lit(kind).alias("kind"), x["end"].alias("end"))).cast(SPAN)


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*(pattern_spans(text, k, kind) for k, kind in enumerate(BASE_KINDS))))


def _clog(c: int) -> int:
    """c*log2(c) in whole units, so that a sum has no error that grows with the run."""
    return round(c * math.log2(c) * UNIT) if c else 0


def window_entropy(s: Column, least: Column, window: int = WINDOW) -> Column:
    """Struct (lo, hi): from the first to the last window of `s` with that entropy; hi is 0 if there is none.

    One pass: the entering and the leaving character change one count each and
    with it the sum of c*log2(c); the entropy is log2(window) - sum/window.
    Counts are held in groups of bits, `PACKED` to a long, so a step costs the
    same wherever in a run it is and however long the run.
    """
    bits, longs = window.bit_length(), -(-(LAST - FIRST + 1) // PACKED)
    gain = F.array(*(F.lit(_clog(c + 1) - _clog(c)) for c in range(window)))
    limit = F.floor((math.log2(window) - least) * (window * UNIT)).cast("long")
    place = lambda c: F.struct((c / PACKED).cast("int").alias("word"), (c % PACKED * bits).alias("shift"))
    mask = (1 << bits) - 1
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["shift"])
    count = lambda counts, x: F.call_function("shiftright", F.get(counts, x["word"]), x["shift"]).bitwiseAND(F.lit(mask)).cast("int")
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("at"), F.lit(-1).alias("lo"), F.lit(0).alias("hi"))

    def marked(acc: Column, limit: Column) -> list[Column]:
        """lo and hi with the window that ends at `at`."""
        high = (acc["at"] >= window) & (acc["sum"] <= limit)
        return [F.when(high & (acc["lo"] < 0), acc["at"] - window).otherwise(acc["lo"]).alias("lo"), F.when(high, acc["at"]).otherwise(acc["hi"]).alias("hi")]

    def run(codes: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            came, left, same = x["came"], x["left"], x["came"] == x["left"]
            change = F.get(gain, count(acc["counts"], came)) - F.when(left.isNull(), F.lit(0)).otherwise(F.get(gain, count(acc["counts"], left) - 1))
            minus = F.when(left.isNull(), F.lit(0)).otherwise(one(left))
            counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == came["word"], one(came)).otherwise(F.lit(0)) - F.when(k == left["word"], minus).otherwise(F.lit(0)))
            kept = F.coalesce(same, F.lit(False))
            return F.struct(F.when(kept, acc["counts"]).otherwise(counts).alias("counts"), F.when(kept, acc["sum"]).otherwise(acc["sum"] + change).alias("sum"), (acc["at"] + 1).alias("at"), *marked(acc, limit))

        moves = F.transform(codes, lambda c, i: F.struct(c.alias("came"), F.when(i >= window, F.get(codes, i - window)).alias("left")))
        return F.aggregate(moves, zero, step, lambda acc: F.struct(*marked(acc, limit)))

    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: place(F.ascii(c) - FIRST))
    return bound(codes, run)


def entropy_spans(text: Column, allow: list[str] | None = None, window: int = WINDOW) -> Column:
    """Spans of windows of high entropy in runs that hold a digit and a letter; no window overlaps what is allowed."""

    def pieces(x: Column) -> Column:
        """What lies between the allowed parts of a run, each a candidate."""
        gaps = F.transform(between(x["hit"], ALLOWED), lambda g: F.struct((x["start"] + g["to"] - F.coalesce(F.char_length(g["hit"]), F.lit(0)) - F.char_length(g["gap"])).alias("start"), g["gap"].alias("hit")))
        return F.when(x["hit"].rlike(ALLOWED), gaps).otherwise(F.array(F.struct(x["start"].alias("start"), x["hit"].alias("hit"))))

    whole = lambda x: ~x["hit"].rlike(ALLOWED_WHOLE) & (~x["hit"].isin(list(allow)) if allow else F.lit(True))
    seem = lambda x: (F.char_length(x["hit"]) >= window) & x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]")

    def spans(x: Column) -> Column:
        kind, least = F.lit(None).cast("string"), F.lit(9.0)
        for name, (pattern, bits) in reversed(ENTROPY_KINDS.items()):
            fits = x["hit"].rlike(pattern)
            kind, least = F.when(fits, name).otherwise(kind), F.when(fits, bits).otherwise(least)
        return bound(F.struct(x["start"].alias("from"), x["hit"].alias("hit"), kind.alias("kind"), least.alias("least")), lambda y: F.struct(y["from"].alias("from"), y["kind"].alias("kind"), window_entropy(y["hit"], y["least"], window).alias("w")))

    names = list(ENTROPY_KINDS)
    order = lambda kind: F.array_position(F.array(*map(F.lit, names)), kind).cast("int") + len(BASE_KINDS)
    likely = F.filter(F.flatten(F.transform(F.filter(F.filter(located(text, CANDIDATE), seem), whole), pieces)), seem)
    found = F.filter(F.transform(likely, spans), lambda y: y["w"]["hi"] > 0)
    return F.transform(found, lambda y: F.struct((y["from"] + y["w"]["lo"]).alias("start"), order(y["kind"]).alias("ord"), y["kind"].alias("kind"), (y["from"] + y["w"]["hi"]).alias("end"))).cast(SPAN)


def find_secrets(df: DataFrame, text_col: str = "text", allow: list[str] | None = None) -> DataFrame:
    """`df` with two columns more: secret_base and secret_spans, arrays of (start, ord, kind, end) by start, then kind.

    Offsets are code points, the end exclusive. Null and empty texts have
    empty arrays. Spans by entropy that lie in a span by pattern are left out;
    allow-listed strings suppress spans by entropy only. No shuffle. The time
    of a text grows as its length: matches are placed by running sums in
    chunks, and windows move by one character at a constant cost. Columns
    named like the two are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("secret_base", base_spans(text)).withColumn("secret_spans", entropy_spans(text, allow))
    is_base = lambda x: x["ord"] < len(BASE_KINDS)

    def free(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda x: F.when(is_base(x), x["end"]).otherwise(F.lit(0))), F.greatest)
        return F.transform(F.filter(F.arrays_zip(spans.alias("span"), reach.alias("reach")), lambda x: is_base(x["span"]) | (x["reach"] < x["span"]["end"])), lambda x: x["span"])

    return df.withColumn("secret_spans", F.when(F.size("secret_spans") == 0, F.col("secret_base")).otherwise(bound(F.array_sort(F.concat("secret_base", "secret_spans")), free)))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """`df` with `mark` in place of each secret; spans that overlap get one mark. Null texts stay null.

    Pieces are cut from the text in UTF-32, where a place is found at once.
    """
    text = F.col(text_col)

    def masked(x: Column) -> Column:
        piece = lambda start, size: F.decode(F.substring(x["wide"], 4 * start + 1, 4 * size), "UTF-32")
        part = lambda span, before: F.when(span["start"] < before, F.lit("")).otherwise(F.concat(piece(before, span["start"] - before), F.lit(mark)))
        before = F.concat(F.array(F.lit(0)), F.slice(x["reach"], F.lit(1), F.size(x["reach"]) - 1))
        last = F.element_at(x["reach"], -1)
        return F.concat(F.array_join(F.zip_with(x["spans"], before, part), ""), piece(last, F.char_length(text) - last))

    reach = running(F.transform("secret_spans", lambda x: x["end"]), F.greatest)
    whole = bound(F.struct(F.encode(text, "UTF-32").alias("wide"), F.col("secret_spans").alias("spans"), reach.alias("reach")), masked)
    return find_secrets(df, text_col).withColumn(text_col, F.when(F.size("secret_spans") > 0, whole).otherwise(text)).drop("secret_base", "secret_spans")


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("secret_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, BASE_KINDS), F.sha2(joined("secret_base"), 256).alias("base_sha256"), joined("secret_spans").alias("spans"))
