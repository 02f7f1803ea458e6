"""A corpus index of immutable segments: a version writes only what changed, readers leave out what is buried."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark import schema as S
from lexispark.runtime import BROADCAST_ROWS, checkpointed, drop_shuffles, small_side

from . import index as I

TABLES = {
    "docs": S.DOCS, "chunks": "path string, chunk_id int, word_count int", "documents": "path string, tags array<string>, updated date, access_count int, confidence string, word_count long, chunk_count long",
    "postings": "term string, path string, field string, chunk_id int, frequency long", "manifest": "path string, hash string, chunks long",
}
#: Segments of one size that are merged, the base of sizes, and the size in bytes up to which all count as one.
FANOUT, SMALL = 4, 1 << 20
#: Rows of tombstones that may be broadcast: paths of some 50 bytes.
FEW = 200_000


class Files:
    """Small files and folders by Hadoop's file systems, so that a corpus may lie anywhere Spark writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def bytes(self, folder: str) -> int:
        path = self._path(f"{self.root}/{folder}")
        return self.fs.getContentSummary(path).getLength() if self.fs.exists(path) else 0

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def commit(self, name: str, text: str) -> bool:
        """Write a file beside its place and rename it there: it is whole or not there at all. False if another one was first."""
        if self.fs.exists(self._path(f"{self.root}/{name}")):
            return False
        beside = self._path(f"{self.root}/_staged/{uuid.uuid4().hex}")
        stream = self.fs.create(beside)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self._path(f"{self.root}/{name}").getParent())
        return self.fs.rename(beside, self._path(f"{self.root}/{name}"))

    def remove(self, folder: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{folder}"), True)


@dataclass
class Version:
    """What a version consists of: segments with their sequence number and bytes, and numbers of tombstone tables."""

    number: int
    segments: list[dict] = field(default_factory=list)  # name, seq, bytes
    tombstones: list[int] = field(default_factory=list)

    def text(self) -> str:
        return json.dumps(self.__dict__)


class SegmentedCorpus:
    """A corpus of knowledge files and its index under one folder.

    A segment holds the docs, chunks, documents, postings and manifest of the files that one version brought; it is never
    changed. A tombstone (path) of version t buries the path in all segments of a lower sequence number. A version is one
    small file that names its segments and tombstones; it is written last and renamed into place, so a writer that dies
    before leaves folders that no version names, and readers keep the version they opened. Segments of like size are merged
    four at a time, so a file is rewritten about log4(corpus / change) times; what versions no longer name goes by `vacuum`.

    Postings of a new segment lie by path and are sorted by term in each file; those of a merged one lie by term.

    Nothing but version files reaches the driver. Chunks keep no text: it is cut anew from the docs where it is needed.
    """

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, small: int = SMALL):
        self.spark, self.root, self.fanout, self.small = spark, root, fanout, small
        self.files = Files(spark, root)

    # ---- reading ----

    def versions(self) -> list[int]:
        return [int(n[1:9]) for n in self.files.names("versions") if n.startswith("v") and n.endswith(".json")]

    def version(self, number: int | None = None) -> Version:
        """A version, by default the newest; of none at all, an empty one."""
        known = self.versions()
        if number is None:
            number = known[-1] if known else 0
        elif number not in known:
            raise LookupError(f"{self.root} has no version {number}")
        return Version(**json.loads(self.files.read(f"versions/v{number:08d}.json"))) if number else Version(0)

    def _buried(self, v: Version) -> DataFrame | None:
        """(path, upto): segments of lower sequence numbers don't count for the path."""
        if not v.tombstones:
            return None
        parts = [self.spark.read.schema("path string").parquet(f"{self.root}/tombstones/t{t:08d}").withColumn("upto", F.lit(t)) for t in v.tombstones]
        return _union(parts).groupBy("path").agg(F.max("upto").alias("upto"))

    def table(self, name: str, v: Version, buried: DataFrame | None = None) -> DataFrame:
        """A table's live rows in a version. Segments that no tombstone is younger than are read as they are."""
        if not v.segments:
            return self.spark.createDataFrame([], TABLES[name])
        if buried is None:
            buried = self._buried(v)
        read = lambda s: self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/segments/{s['name']}/{name}")
        last = max(v.tombstones, default=0)
        clean = [read(s) for s in v.segments if s["seq"] >= last]
        rest = [read(s).withColumn("__seq", F.lit(s["seq"])) for s in v.segments if s["seq"] < last]
        if rest:
            gone = buried.withColumnRenamed("path", "__path")
            old = _union(rest)
            clean.append(self._live(old, gone, v, last) if name == "postings" else _unburied(old, gone))
        return _union(clean)

    def _live(self, old: DataFrame, gone: DataFrame, v: Version, last: int) -> DataFrame:
        """What `gone` (__path, upto) leaves of the postings of segments before `last`, which aren't shuffled while its hashes may be broadcast.

        A row with none of these hashes lives, one with such a hash doesn't, but for paths that share a hash with another one: those meet the paths themselves.
        """
        if not FEW < gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            return _unburied(old, gone)
        manifest = _union([self.spark.read.schema(TABLES["manifest"]).parquet(f"{self.root}/segments/{s['name']}/manifest").select("path") for s in v.segments if s["seq"] < last])
        every = manifest.unionByName(gone.select(F.col("__path").alias("path")))
        same = every.groupBy(path_key("path").alias("__key")).agg(F.min("path").alias("a"), F.max("path").alias("b")).filter("a <> b").select("__key")
        same = small_side(checkpointed(same))
        hashes = F.broadcast(gone.groupBy(path_key("__path").alias("__hash")).agg(F.max("upto").alias("upto")))
        keyed = old.withColumn("__key", path_key("path"))
        alone = keyed.join(same, "__key", "left_anti")
        alone = alone.join(hashes, (alone["__key"] == hashes["__hash"]) & (alone["__seq"] < hashes["upto"]), "left_anti").drop("__seq", "__key")
        if same.isEmpty():
            return alone
        return alone.unionByName(_unburied(keyed.join(same, "__key", "left_semi").drop("__key"), gone))

    def index(self, number: int | None = None) -> I.Index:
        """A version's index; its postings are read by term, its chunks have no text."""
        v = self.version(number)
        buried = self._buried(v)
        if buried is not None:
            buried = small_side(checkpointed(buried), FEW)
        t = {name: self.table(name, v, buried) for name in ("docs", "chunks", "documents", "postings")}
        return I.Index(t["docs"], t["chunks"], t["documents"], t["postings"], I.stats_table(t["documents"]), saved=True)

    def current(self) -> I.Index:
        if not self.versions():
            raise LookupError(f"{self.root} holds no version")
        return self.index()

    def manifest(self, number: int | None = None) -> DataFrame:
        return self.table("manifest", self.version(number))

    def bytes_of(self, number: int) -> int:
        """Bytes that a version wrote: its own segments and tombstones."""
        return self.files.bytes(f"tombstones/t{number:08d}") + sum(self.files.bytes(f"segments/{n}") for n in self.files.names("segments") if n.startswith(f"s{number:08d}"))

    # ---- writing ----

    def _write_segment(self, tables: dict[str, DataFrame | Callable[[str], DataFrame]], number: int, kind: str) -> dict:
        """Tables in their order, each as it is or made of the segment's folder, where those before it lie."""
        name = f"s{number:08d}-{kind}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.root}/segments/{name}"
        for table, df in tables.items():
            out = (df(folder) if callable(df) else df).select([c.split()[0] for c in _columns(TABLES[table])])
            if table == "postings":
                out = out.repartitionByRange("term").sortWithinPartitions("term", "path")
            I.written(out, f"{folder}/{table}", "error")
        self.files.remove(f"segments/{name}/postings.cut")
        drop_shuffles(self.spark)
        return {"name": name, "seq": number, "bytes": self.files.bytes(f"segments/{name}")}

    def _segment_of(self, docs: DataFrame, number: int) -> dict:
        """The segment of some files: one pass over their texts writes the postings, and chunks of which the other tables are made."""

        def read(folder: str, table: str) -> DataFrame:
            return self.spark.read.schema(TABLES[table]).parquet(f"{folder}/{table}")

        def manifest(folder: str) -> DataFrame:
            counts = read(folder, "documents").select("path", F.col("chunk_count").alias("chunks"))
            return I.file_hashes(read(folder, "docs")).join(counts, "path", "left").fillna(0, ["chunks"])

        tables = {
            "docs": docs, "chunks": lambda folder: I.write_postings(read(folder, "docs"), f"{folder}/postings"),
            "documents": lambda folder: I.document_table(read(folder, "docs"), read(folder, "chunks")), "manifest": manifest,
        }
        return self._write_segment(tables, number, "delta")

    def apply(self, changed: DataFrame, gone: DataFrame | None = None, number: int | None = None) -> dict:
        """The next version: `changed` files (with all columns of docs) come or replace others, paths in `gone` go.

        Costs what changed, and merges. Files must have one row a path. A `number` that is there already is left alone, so a
        micro-batch that is run again changes nothing.
        """
        old = self.version()
        known = self.versions()
        number = old.number + 1 if number is None else number
        if number in known:
            return {"version": number, "skipped": True}
        if known and number < known[-1]:
            raise ValueError(f"version {number} would come before {known[-1]}")
        changed = checkpointed(changed.select([c.split()[0] for c in _columns(S.DOCS)]))
        paths = changed.select("path")
        bury = (paths.unionByName(gone.select("path")) if gone is not None else paths).distinct()
        new = Version(number, list(old.segments), list(old.tombstones))
        if old.segments:
            live = self.table("manifest", old).select("path")
            bury = checkpointed(bury.join(live, "path", "left_semi"))
            if not bury.isEmpty():
                bury.coalesce(1 + int(self.files.bytes("tombstones") > 64 << 20)).write.mode("overwrite").parquet(f"{self.root}/tombstones/t{number:08d}")
                new.tombstones.append(number)
        if not changed.isEmpty():
            new.segments.append(self._segment_of(changed, number))
        merged = self._merge(new)
        if not self.files.commit(f"versions/v{number:08d}.json", new.text()):
            return {"version": number, "skipped": True}
        return {"version": number, "merged": merged, "bytes": self.bytes_of(number)}

    def publish(self, docs: DataFrame, number: int | None = None) -> dict:
        """The version in which the corpus is `docs`: hashes tell what changed, and only that is cut, tokenised and written.

        A whole rebuild where that is cheaper (`index.rebuild_is_cheaper`).
        """
        known = self.versions()
        if number is not None and number in known:
            return {"version": number, "skipped": True}
        if not known:
            return {**self.apply(docs, number=number), "rebuilt": True}
        diff = checkpointed(I.manifest_diff(self.manifest(), I.file_hashes(docs)))
        n = {r["state"]: r["count"] for r in diff.groupBy("state").count().collect()}
        dirty, deleted, files = n.get("dirty", 0), n.get("deleted", 0), sum(n.values()) - n.get("deleted", 0)
        if I.rebuild_is_cheaper(dirty, deleted, files, True):
            return {**self.rebuild(docs, number), **n}
        changed = docs.join(diff.filter("state = 'dirty'").select("path"), "path", "left_semi")
        return {**self.apply(changed, diff.filter("state = 'deleted'").select("path"), number), "rebuilt": False, **n}

    def rebuild(self, docs: DataFrame, number: int | None = None) -> dict:
        """A version of one new segment."""
        number = self.version().number + 1 if number is None else number
        new = Version(number, [self._segment_of(docs, number)])
        self.files.commit(f"versions/v{number:08d}.json", new.text())
        return {"version": number, "rebuilt": True, "bytes": self.bytes_of(number)}

    def tier(self, size: int) -> int:
        return 0 if size <= self.small else 1 + int(math.log(size / self.small, self.fanout))

    def _merge(self, v: Version) -> int:
        """Merge segments of one tier where there are `fanout`, from the smallest tier on; tombstones that bury nothing more go."""
        merges = 0
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in v.segments:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)
            if full is None:
                break
            part = Version(v.number, full, v.tombstones)
            buried = self._buried(part)
            if buried is not None:
                buried = small_side(checkpointed(buried), FEW)
            tables = {name: self.table(name, part, buried) for name in TABLES}
            one = self._write_segment(tables, v.number, "merge")
            v.segments = [s for s in v.segments if s not in full] + [one]
            merges += 1
        oldest = min((s["seq"] for s in v.segments), default=v.number)
        v.tombstones = [t for t in v.tombstones if t > oldest]
        return merges

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove versions but the newest `keep`, and segments and tombstones that none of these names. No writer may be at work."""
        known = self.versions()
        kept = [self.version(n) for n in known[-keep:]]
        segments = {s["name"] for v in kept for s in v.segments}
        tombs = {f"t{t:08d}" for v in kept for t in v.tombstones}
        gone = [f"versions/v{n:08d}.json" for n in known[:-keep]]  # first, so that no version names what is missing
        gone += [f"segments/{n}" for n in self.files.names("segments") if n not in segments]
        gone += [f"tombstones/{n}" for n in self.files.names("tombstones") if n not in tombs]
        for name in [*gone, "_staged"]:
            self.files.remove(name)
        return gone


def path_key(name: str) -> Column:
    return F.xxhash64(name)


def _unburied(old: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (path, __seq) of `old` that no row (__path, upto) of `gone` with a higher number names."""
    return old.join(gone, (old["path"] == gone["__path"]) & (old["__seq"] < gone["upto"]), "left_anti").drop("__seq")


def _columns(schema: str) -> list[str]:
    return schema.replace("array<string>", "array").split(", ")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
