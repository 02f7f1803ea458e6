"""Text functions as column expressions: tokens, stems, tags, tables, snippets, hashes, list lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes in the order they are tried, and two lists of stop words.
SUFFIXES = ("tion", "ment", "ness", "able", "ible", "ies", "ing", "est", "ed", "er", "ly", "s")
QUERY_STOP_WORDS = ["the", "is", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "it", "this", "that", "are", "was", "be", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "i", "me", "my", "we", "you", "your", "what", "how", "why", "when", "where", "which", "who", "about", "think"]
TAG_STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can", "that", "this", "it", "as", "if", "because", "while", "when", "where"]

#: What is neither letter nor digit at the edges of words, found in one pass over the text.
_EDGES = r"(?<!\S)[^\p{L}\p{Nd}\s]+|[^\p{L}\p{Nd}\s]+(?!\S)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once; written out in the places where it is used, it would be computed at each of them."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Lower-case words without the marks around them; duplicates and order stay. Null gives an empty array."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _EDGES, ""), r"\s+", " "))
    return F.array_remove(F.split(bare, " "), "")  # only an empty text has an empty word; a test for it would compute the text twice


def stem(token: Column) -> Column:
    """The first suffix that leaves three bytes or more goes, once. Most tokens don't end in a last letter of one and pass at once."""
    size, out = F.octet_length(token), F.when(~F.right(token, F.lit(1)).isin(sorted({s[-1] for s in SUFFIXES})), token)
    for s in SUFFIXES:
        fits = token.endswith(s) & (size >= len(s) + 3)
        cut = F.substring(token, F.lit(1), F.char_length(token) - len(s))
        out = out.when(fits, cut)
    return out.otherwise(token)


def surface_forms(terms: list[str]) -> list[str]:
    """Every token whose stem may be one of the terms."""
    return sorted({t + s for t in terms for s in ("", *SUFFIXES)})


def stems(text: Column) -> Column:
    return F.transform(tokens(text), stem)


def query_terms(text: str) -> list[str]:
    """Stems of a query, on the driver; the same rules as `stems`."""
    out = []
    for w in text.lower().split():
        w = re.sub(r"^[\W_]+|[\W_]+$", "", w)
        if w:
            s = next((s for s in SUFFIXES if w.endswith(s) and len(w.encode()) >= len(s) + 3), "")
            out.append(w[: len(w) - len(s)])
    return out


def query_keywords(text: str) -> list[str]:
    """Words of a query that are no stop words, as the tag search takes them."""
    words = (w.strip("?!.,;:'\"") for w in text.lower().split())
    return [w for w in words if w and w not in QUERY_STOP_WORDS]


def keywords(text: Column) -> Column:
    """`query_keywords` for a column."""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"""^[?!.,;:'"]+|[?!.,;:'"]+$""", ""))
    return F.filter(words, lambda w: (w != "") & ~w.isin(QUERY_STOP_WORDS))


def chunks(text: Column, target: int = 200) -> Column:
    """Chunks of about `target` words.

    Paragraphs (apart by an empty line) gather until the next one would not
    fit; one that is longer by itself is cut every `target` words. Null and
    blank texts give one empty chunk.
    """
    trimmed = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    paragraphs = F.filter(F.transform(F.split(trimmed(F.coalesce(text, F.lit(""))), "\n\n"), trimmed), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        return _let(F.split(p, r"\s+"), lambda words: added(acc, p, words))  # a paragraph is trimmed and not empty, so no word is empty

    def added(acc: Column, p: Column, words: Column) -> Column:
        n = F.size(words)
        flushed = F.when(acc["n"] > 0, F.array_append(acc["done"], acc["held"])).otherwise(acc["done"])
        cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / target).cast("int")), lambda i: F.array_join(F.slice(words, i * target + 1, F.lit(target)), " "))
        full = acc["n"] + n > target
        alone = F.struct(F.concat(flushed, cut).alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"))
        fresh = F.struct(flushed.alias("done"), p.alias("held"), n.alias("n"))
        more = F.struct(acc["done"].alias("done"), F.when(acc["n"] > 0, F.concat(acc["held"], F.lit("\n\n"), p)).otherwise(p).alias("held"), (acc["n"] + n).alias("n"))
        return F.when(n > target, alone).when((acc["n"] > 0) & full, fresh).otherwise(more)

    end = lambda acc: F.when((acc["n"] > 0) | (F.size(acc["done"]) == 0), F.array_append(acc["done"], acc["held"])).otherwise(acc["done"])
    return F.aggregate(paragraphs, zero, step, end)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 24)


def conversation_hash(messages: Column) -> Column:
    """Of an array of (role, content)."""
    lines = F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"], F.lit("\n")))
    return F.substring(F.sha2(F.array_join(lines, ""), 256), 1, 16)


def first_line(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n", 2)[0]


def snippet(text: Column, most: int = 200) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def escape_cell(text: Column) -> Column:
    """One table cell: white space as single blanks, entities for &, <, >, and escaped bars."""
    x = F.trim(F.regexp_replace(text, r"\s+", " "))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "\\|")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def markdown_table(header: Column, rows: Column) -> Column:
    """A table from an array of cells and an array of arrays; rows are padded or cut to the header."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, escape_cell), " | "), F.lit(" |\n"))
    fit = lambda row: F.transform(header, lambda h, i: F.coalesce(F.get(row, i), F.lit("")))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(header, lambda h: F.lit(" --- |")), ""), F.lit("\n"))
    return F.concat(line(header), rule, F.array_join(F.transform(rows, lambda r: line(fit(r))), ""))


def compact_sheet(sheet: Column, cells: Column, rows: Column) -> Column:
    """A sheet's values as lines, without its empty rows, under one line that names it."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    lines = F.transform(F.filter(clean, lambda r: F.exists(r, lambda c: c != "")), lambda r: F.concat(F.array_join(r, " | "), F.lit("\n")))
    return F.concat(F.lit("sheet:"), sheet, F.lit(" range:"), cells, F.lit("\n"), F.array_join(lines, ""))


def escape_pipe(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def safe_substring(text: Column, offset: Column, length: Column) -> Column:
    """Characters from an offset, trimmed; the whole text if the offset lies behind it."""
    cut = F.regexp_replace(F.substring(text, offset + 1, length), r"^\s+|\s+$", "")
    return F.when(offset >= F.char_length(text), text).otherwise(cut)


def chunk_key_path(key: Column) -> Column:
    """The path of "path#chunk"; a key without # is a path."""
    return F.when(key.contains("#"), F.regexp_replace(key, "#[^#]*$", "")).otherwise(key)


def chunk_key_label(key: Column) -> Column:
    """File name without .md, and the chunk."""
    name = F.regexp_replace(F.substring_index(chunk_key_path(key), "/", -1), r"\.md$", "")
    return F.when(key.contains("#"), F.concat(name, F.lit(" #"), F.substring_index(key, "#", -1))).otherwise(name)


def first_segment(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def skipped_in_sync(path: Column) -> Column:
    """What isn't copied: the trash, index files and the file manager's own."""
    return path.startswith(".trash/") | path.startswith(".trash\\") | path.isin(".gitignore", ".DS_Store", "index_full.json.gz", "vectors.bin.gz")


def expand_environment(text: str, values: Mapping[str, str]) -> str:
    """A configuration text with ${NAME} as the value of that name, or nothing; on the driver."""
    return re.sub(r"\$\{(\w+)\}", lambda m: values.get(m[1], ""), text, flags=re.ASCII)


def title_of_slug(slug: Column) -> Column:
    words = F.filter(F.split(F.replace(slug, F.lit("-"), F.lit(" ")), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.char_length(w)))), " ")


def since_days(text: Column) -> Column:
    """Days of "7d" or "2w"; null if it is neither or not above zero."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"^\+?(\d+)([dw])$", 1).try_cast("int") * F.when(t.endswith("w"), 7).otherwise(1)
    return F.when(n > 0, n)


def newer_version(candidate: Column, current: Column) -> Column:
    """Whether a version of three numbers is above another; a leading v doesn't count."""
    part = lambda v, i: F.coalesce(F.get(F.split(F.regexp_replace(v, "^v", ""), r"\."), F.lit(i)).try_cast("int"), F.lit(0))
    three = lambda v: F.struct(*(part(v, i).alias(f"p{i}") for i in range(3)))
    return three(candidate) > three(current)


def fill_template(text: Column, name: str, value: Column) -> Column:
    return F.replace(text, F.lit("{{" + name + "}}"), value)


def repo_name(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(url, r"\.git$", ""), "/", -1)


def merge_tags(old: Column, new: Column) -> Column:
    """Old tags in their order, then unseen ones; each once."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(old, none), F.coalesce(new, none))


def parse_date(text: Column) -> Column:
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_timestamp(text).cast("date"))


# ---- task and goal lists ----

TASK = r"^- \[([ x~])\] (.+)$"
GOAL = r"^- \[([ x])\] \[([^\]]+)\] (.+)$"
_PRIORITY = {"high": "\U0001f534", "medium": "\U0001f7e1", "low": "\U0001f7e2"}


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def priority(text: Column) -> Column:
    out = F
    for name, mark in _PRIORITY.items():
        out = out.when(text.contains(mark), name)
    return out.otherwise("")


def parse_tasks(text: Column) -> Column:
    """Array of (text, done, priority)."""
    lines = F.filter(F.transform(F.split(text, "\n"), _stripped), lambda x: x.rlike(TASK))
    body = lambda x: F.regexp_extract(x, TASK, 2)
    return F.transform(lines, lambda x: F.struct(body(x).alias("text"), (F.regexp_extract(x, TASK, 1) == "x").alias("done"), priority(body(x)).alias("priority")))


def parse_goals(text: Column) -> Column:
    """Array of (text, horizon, done)."""
    lines = F.filter(F.transform(F.split(text, "\n"), _stripped), lambda x: x.rlike(GOAL))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, GOAL, 3).alias("text"), F.regexp_extract(x, GOAL, 2).alias("horizon"), (F.regexp_extract(x, GOAL, 1) == "x").alias("done")))


def _numbered(text: Column, pattern: str) -> Column:
    """Array of (line, n): n counts the matching lines from 0 and is -1 elsewhere."""
    zero = F.struct(F.array().cast("array<struct<line:string,n:int>>").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, line: Column) -> Column:
        hit = _stripped(line).rlike(pattern)
        return F.struct(F.array_append(acc["out"], F.struct(line.alias("line"), F.when(hit, acc["n"]).otherwise(-1).alias("n"))).alias("out"), F.when(hit, acc["n"] + 1).otherwise(acc["n"]).alias("n"))

    return F.aggregate(F.split(text, "\n"), zero, step, lambda acc: acc["out"])


def toggle_task(text: Column, index: Column, done: Column) -> Column:
    """Every box on the line of that task; null where there is no such task."""
    lines = _numbered(text, TASK)
    mark = F.when(done, F.lit("[x]")).otherwise(F.lit("[ ]"))
    changed = F.transform(lines, lambda x: F.when(x["n"] == index, F.regexp_replace(x["line"], F.lit(r"\[[ x~]\]"), mark)).otherwise(x["line"]))
    return F.when(F.exists(lines, lambda x: x["n"] == index), F.array_join(changed, "\n"))


def toggle_goal(text: Column, index: Column, done: Column) -> Column:
    """The first box only, so a horizon called x stays; null where there is no such goal."""
    lines = _numbered(text, GOAL)
    mark = F.when(done, F.lit("$1[x]")).otherwise(F.lit("$1[ ]"))
    changed = F.transform(lines, lambda x: F.when(x["n"] == index, F.regexp_replace(x["line"], F.lit(r"^(\s*- )\[[ x]\]"), mark)).otherwise(x["line"]))
    return F.when(F.exists(lines, lambda x: x["n"] == index), F.array_join(changed, "\n"))


def remove_task(text: Column, index: Column) -> Column:
    lines = _numbered(text, TASK)
    kept = F.transform(F.filter(lines, lambda x: x["n"] != index), lambda x: x["line"])
    return F.when(F.exists(lines, lambda x: x["n"] == index), F.array_join(kept, "\n"))


def _append_line(text: Column, line: Column) -> Column:
    return F.concat(text, F.when(F.regexp_replace(text, r"[ \t]+$", "").endswith("\n"), "").otherwise("\n"), line, F.lit("\n"))


def append_task(text: Column, task: Column, level: Column) -> Column:
    mark = F
    for name, m in _PRIORITY.items():
        mark = mark.when(level == name, m + " ")
    return _append_line(text, F.concat(F.lit("- [ ] "), mark.otherwise(""), task))


def append_goal(text: Column, goal: Column, horizon: Column) -> Column:
    h = F.when(F.coalesce(horizon, F.lit("")) == "", "medium").otherwise(horizon)
    return _append_line(text, F.concat(F.lit("- [ ] ["), h, F.lit("] "), goal))


def auto_tags(text: Column, most: int = 5) -> Column:
    """The most frequent words of headings and word pairs of the first other line; ties by name."""
    bare = lambda w: F.regexp_replace(w, r"^[.,!?;:]+|[.,!?;:]+$", "")
    useful = lambda w: (F.octet_length(w) > 2) & ~w.isin(TAG_STOP_WORDS)
    words = lambda s: F.transform(F.filter(F.split(F.lower(s), r"\s+"), lambda w: w != ""), bare)

    def of(lines: Column) -> Column:
        heads = F.flatten(F.transform(F.filter(lines, lambda x: x.startswith("#")), lambda x: F.filter(words(F.regexp_replace(x, "^[# ]+", "")), useful)))
        first = F.coalesce(F.get(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), F.lit(0)), F.lit(""))
        pairs = _let(words(first), lambda w: F.filter(F.transform(w, lambda a, i: F.when(useful(a) & useful(F.get(w, i + 1)), F.concat(a, F.lit("-"), F.get(w, i + 1)))), lambda p: p.isNotNull()))
        return F.array_sort(F.concat(heads, pairs))

    def counted(found: Column) -> Column:
        """A sorted list has a tag's repeats side by side: where the last of them is, less where the first is, gives their number."""
        last = F.filter(F.sequence(F.lit(1), F.size(found)), lambda i: (i == F.size(found)) | (F.element_at(found, i) != F.get(found, i)))
        return F.when(F.size(found) == 0, F.array().cast("array<struct<n:int,tag:string>>")).otherwise(_let(last, lambda ends: F.transform(ends, lambda i, k: F.struct((F.coalesce(F.get(ends, k - 1), F.lit(0)) - i).alias("n"), F.element_at(found, i).alias("tag")))))

    return _let(_let(F.transform(F.split(text, "\n"), _stripped), of), lambda found: F.transform(F.slice(F.array_sort(counted(found)), 1, most), lambda x: x["tag"]))


# For each language (kind, pattern) in the order tried on each line.
SYMBOLS = {
    "ts": [("func", r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("type", r"^(?:export\s+)?class\s+(\w+)"), ("type", r"^(?:export\s+)?(?:interface|type)\s+(\w+)")],
    "py": [("func", r"^def\s+(\w+)"), ("type", r"^class\s+(\w+)")],
    "go": [("func", r"^func\s+(\w+)"), ("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("type", r"^type\s+(\w+)")],
}


def symbols(source: Column, language: str) -> Column:
    """Array of (name, kind, code) by line patterns; Go declarations are found by their first lines too, those in a `type (...)` group last."""

    def of(line: Column) -> Column:
        out = F
        for kind, p in SYMBOLS[language]:
            out = out.when(line.rlike(p), F.struct(F.regexp_extract(line, p, 1).alias("name"), F.lit(kind).alias("kind"), F.substring(_stripped(line), 1, 200).alias("code")))
        return out.otherwise(F.lit(None))

    found = F.filter(F.transform(F.split(source, "\n"), of), lambda s: s.isNotNull())
    if language != "go":
        return found
    member = r"^(?:\t| {2,4})(\w+)(?:\[[^\]]*\])?\s+\S"
    lines = F.split(F.array_join(F.regexp_extract_all(source, F.lit(r"(?ms)^type \($(.*?)^\)"), 1), "\n"), "\n")
    grouped = F.transform(F.filter(lines, lambda x: x.rlike(member)), lambda x: F.struct(F.regexp_extract(x, member, 1).alias("name"), F.lit("type").alias("kind"), F.substring(_stripped(x), 1, 200).alias("code")))
    return F.concat(found, grouped)


#: A text up to its next bracket that stands in no string, from where the last match ended: a string without end stops all. All loops are possessive, so one pass without a stack.
_TO_BRACKET = r'\G(?s)[^"\[\]]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^"\[\]]*+)*+[\[\]]'


def json_array(text: Column) -> Column:
    """The first [ up to its ], minding strings and escapes; the trimmed text if there is none.

    The fold runs over the brackets outside of strings, not over characters.
    """
    zero = F.struct(*(F.lit(0).alias(k) for k in ("size", "depth", "end")))

    def step(a: Column, part: Column) -> Column:
        return _let(F.struct((a["size"] + F.char_length(part)).alias("size"), (a["depth"] + F.when(part.endswith("["), 1).otherwise(-1)).alias("depth"), a["end"].alias("end")), lambda b: F.struct(
            b["size"].alias("size"), b["depth"].alias("depth"), F.when((b["end"] == 0) & (b["depth"] == 0), b["size"]).otherwise(b["end"]).alias("end")))

    def found(trimmed: Column) -> Column:
        return _let(F.regexp_extract(trimmed, r"(?s)\[.*+", 0), lambda tail: _let(F.aggregate(F.regexp_extract_all(tail, F.lit(_TO_BRACKET), F.lit(0)), zero, step)["end"], lambda end: F.when(end > 0, F.substring(tail, F.lit(1), end)).otherwise(trimmed)))

    return _let(_stripped(text), found)
