"""Knowledge files, tables and code as sources, and files as a sink."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as T

from .sink import save_files

_HEAD = r"(?s)^---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"
CODE = {"go": "go", "ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "py": "py"}
IGNORED = "node_modules|vendor|\\.git|dist|build|\\.next|__pycache__|\\.venv|venv|target"


def safe_path(path: Column) -> Column:
    """Whether a relative path stays inside its root."""
    return ~path.startswith("/") & ~F.exists(F.split(path, "/"), lambda p: p == "..")


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Files *.md under `root` but not in .trash/ or .staged/, as rows of the corpus."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    path = F.regexp_replace(F.regexp_replace("_metadata.file_path", "^[a-z]+:/+", "/"), f"^{re.escape(re.sub('^[a-z]+:/+', '/', root).rstrip('/'))}/", "")
    return parse_front_matter(files.select(path.alias("path"), F.col("value").alias("raw")).filter(~F.col("path").startswith(".trash/") & ~F.col("path").startswith(".staged/")))


def parse_front_matter(files: DataFrame) -> DataFrame:
    """(path, raw) as rows of the corpus: the known keys of the header, the rest of the file as content."""
    raw = F.col("raw")
    head = F.regexp_extract(raw, _HEAD, 1)
    value = lambda k: F.regexp_replace(F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*?)[ \t]*\r?$", 1)), "^[\"']|[\"']$", "")
    inline = F.split(F.regexp_extract(head, r"(?m)^tags:[ \t]*\[(.*?)\]", 1), ",")
    block = F.split(F.regexp_extract(head, r"(?m)^tags:[ \t]*\r?\n((?:[ \t]*- .*(?:\r?\n|$))+)", 1), r"\r?\n")
    clean = lambda xs: F.filter(F.transform(xs, lambda t: F.regexp_replace(F.trim(t), r"^(- *)?[\"']?|[\"']$", "")), lambda t: t != "")
    return files.select(
        "path", F.concat(clean(inline), clean(block)).alias("tags"), F.nullif(value("confidence"), F.lit("")).alias("confidence"), F.nullif(value("source"), F.lit("")).alias("source"),
        T.parse_date(value("updated")).alias("updated"), F.coalesce(value("access_count").try_cast("int"), F.lit(0)).alias("access_count"), T.parse_date(value("last_accessed")).alias("last_accessed"),
        F.when(raw.rlike(_HEAD), F.regexp_replace(raw, _HEAD, "")).otherwise(raw).alias("content"),
    )


def file_text(docs: DataFrame) -> DataFrame:
    """(path, raw): each row as the text of a file."""
    line = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\n"))).otherwise("")
    head = F.concat(
        F.lit("---\ntags: ["), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", "), F.lit("]\n"), line("confidence", F.col("confidence")), line("source", F.col("source")), line("updated", F.col("updated").cast("string")),
        F.when(F.col("access_count") > 0, line("access_count", F.col("access_count").cast("string"))).otherwise(""), line("last_accessed", F.col("last_accessed").cast("string")), F.lit("---\n\n"),
    )
    return docs.select("path", F.concat(head, F.regexp_replace("content", r"^\n+", "")).alias("raw"))


def write_markdown(docs: DataFrame, root: str) -> str | None:
    """One file for each row whose path is safe, all or none of them; what they replace goes to .trash/ under the name that is returned."""
    return save_files(file_text(docs.filter(safe_path(F.col("path")))), root)


def _table(rows: list[list[str]]) -> str:
    esc = lambda s: " ".join(s.split()).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("|", "\\|")
    width = len(rows[0])
    line = lambda r: "| " + " | ".join(esc(c) for c in (r + [""] * width)[:width]) + " |\n"
    return line(rows[0]) + "|" + " --- |" * width + "\n" + "".join(map(line, rows[1:]))


def csv_table(data: bytes) -> str:
    rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")) if r]
    if not rows:
        raise ValueError("an empty table")
    if any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("rows of different lengths")
    return _table(rows)


def xlsx_table(data: bytes) -> str:
    """All sheets as tables, under their names if there are several."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        read = lambda n: ElementTree.fromstring(z.read(n))
        strings = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in read("xl/sharedStrings.xml").findall("m:si", ns)] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") for s in read("xl/workbook.xml").find("m:sheets", ns)]
        out = []
        for k, title in enumerate(titles, 1):
            rows = []
            for r in read(f"xl/worksheets/sheet{k}.xml").iter(f"{{{ns['m']}}}row"):
                cells: list[str] = []
                for c in r.findall("m:c", ns):
                    at = 0
                    for ch in re.match("[A-Z]*", c.get("r", "")).group():
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (at - 1 - len(cells))
                    v, t = c.find("m:v", ns), c.get("t")
                    text = v.text if v is not None and v.text else ""
                    cells.append(strings[int(text)] if t == "s" and text else "".join(x.text or "" for x in c.iter(f"{{{ns['m']}}}t")) if t == "inlineStr" else text)
                rows.append(cells)
            if rows and any(rows):
                out.append((title, _table(rows)))
    return "\n".join(f"## {n}\n\n{t}" if len(titles) > 1 else t for n, t in out)


def import_files(spark: SparkSession, pattern: str, category: str, as_of: str, tags: list[str] | None = None) -> DataFrame:
    """Markdown, CSV and XLSX files as rows of the corpus: category/basename.md, tagged by themselves too."""
    files = spark.read.format("binaryFile").load(pattern)

    def convert(frames):
        how = {"md": lambda b: b.decode("utf-8", "replace"), "csv": csv_table, "xlsx": xlsx_table}
        for f in frames:
            names = f["path"].str.rsplit("/", n=1).str[-1]
            kinds = names.str.rsplit(".", n=1).str[-1].str.lower()
            keep = kinds.isin(list(how))
            yield pd.DataFrame({"name": names[keep], "content": [how[k](b) for k, b in zip(kinds[keep], f["content"][keep])]})

    x = files.select("path", "content").mapInPandas(convert, "name string, content string")
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    given = F.array(*map(F.lit, tags)) if tags else F.array().cast("array<string>")
    return x.select(
        F.concat(F.lit(f"{category}/"), stem, F.lit(".md")).alias("path"), T.merge_tags(given, T.auto_tags(F.col("content"))).alias("tags"), F.lit("medium").alias("confidence"),
        F.concat(F.lit("imported:"), "name").alias("source"), F.lit(as_of).cast("date").alias("updated"), F.lit(0).alias("access_count"), F.lit(None).cast("date").alias("last_accessed"), F.col("content"),
    )


def read_code(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """(path, hash, language, name, kind, code): symbols of source files, without files whose (path, hash) is known."""
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("src"))
    ext = F.substring_index("path", ".", -1)
    x = files.filter(ext.isin(list(CODE)) & ~F.col("path").rlike(f"/({IGNORED})/")).withColumn("hash", T.content_hash(F.col("src")))
    if known is not None:
        x = x.join(known.select("path", "hash"), ["path", "hash"], "left_anti")
    language = F.create_map(*(F.lit(v) for kv in CODE.items() for v in kv))[ext]
    found = F
    for lang in ("go", "ts", "py"):
        found = found.when(language == lang, T.symbols(F.col("src"), lang))
    return x.select("path", "hash", language.alias("language"), F.explode(found).alias("s")).select("path", "hash", "language", "s.*")
