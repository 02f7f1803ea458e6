"""Files as a sink of Spark: staged by tasks, committed by one record, moved into place so often as it takes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STAGED, TRASH, RECORD, ACTIONS = ".staged", ".trash", "committed.json", "actions.json"
#: Task folders that one task moves into place.
FOLDERS = 4


class SinkError(RuntimeError):
    pass


class Folder:
    """A folder on any file system that pyarrow opens."""

    def __init__(self, address: str):
        from pyarrow import fs

        uri = address if "://" in address else "file://" + address.removeprefix("file:")
        self.fs, self.root = fs.FileSystem.from_uri(uri)
        self.kinds = fs

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def there(self, name: str) -> bool:
        return self.fs.get_file_info(self.at(name)).type != self.kinds.FileType.NotFound

    def names(self, folder: str) -> list[str]:
        return sorted(i.base_name for i in self.fs.get_file_info(self.kinds.FileSelector(self.at(folder), allow_not_found=True)))

    def write(self, name: str, data: bytes) -> None:
        """A file that appears whole."""
        part = f"{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.at(name).rsplit("/", 1)[0])
        with self.fs.open_output_stream(self.at(part)) as f:
            f.write(data)
        self.fs.move(self.at(part), self.at(name))

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(self.at(name)) as f:
            return f.read()

    def move(self, source: str, target: str) -> None:
        self.fs.create_dir(self.at(target).rsplit("/", 1)[0])
        self.fs.move(self.at(source), self.at(target))

    def copy(self, source: str, target: str) -> None:
        part = f"{target}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.at(target).rsplit("/", 1)[0])
        self.fs.copy_file(self.at(source), self.at(part))
        self.fs.move(self.at(part), self.at(target))

    def remove(self, folder: str) -> None:
        try:
            self.fs.delete_dir(self.at(folder))
        except FileNotFoundError:
            pass


def checked_path(path: str | None) -> str:
    """A relative path that stays inside of its root and out of the sink's own folders."""
    parts = (path or "").split("/")
    if not path or "" in parts or "." in parts or ".." in parts or parts[0] in (STAGED, TRASH):
        raise SinkError(f"not a path inside of the root: {path!r}")
    return path


def roll_forward(folder: Folder, job: str, task: str) -> None:
    """Move a task's files into place. It may be run again after it stopped anywhere: what is done isn't staged any more.

    What a file replaces, or what is to go, is in `.trash/<job>` first, so there is no moment without the old or the new file.
    """
    own = f"{STAGED}/{job}/{task}"
    for path, staged in json.loads(folder.read(f"{own}/{ACTIONS}")):
        trash = f"{TRASH}/{job}/{path}"
        try:
            if staged is None:
                if folder.there(path):
                    folder.move(path, trash)
            elif folder.there(f"{own}/{staged}"):
                if folder.there(path) and not folder.there(trash):
                    folder.copy(path, trash)
                folder.move(f"{own}/{staged}", path)
        except FileNotFoundError:  # another one that rolls forward was faster
            if staged is not None and folder.there(f"{own}/{staged}"):
                raise


@dataclass
class Staged(WriterCommitMessage):
    task: str
    files: int


class FilesWriter(DataSourceWriter):
    def __init__(self, root: str, finish: bool):
        self.root, self.finish, self.job = root, finish, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Staged:
        """Files of a task in a folder that only this attempt has; an attempt that fails takes its folder away."""
        folder, task = Folder(self.root), uuid.uuid4().hex
        own, actions, seen = f"{STAGED}/{self.job}/{task}", [], set()
        try:
            folder.fs.create_dir(folder.at(own))
            for k, row in enumerate(rows):
                path = checked_path(row["path"])
                if path in seen:
                    raise SinkError(f"two rows for {path}")
                seen.add(path)
                if row["raw"] is not None:
                    with folder.fs.open_output_stream(folder.at(f"{own}/{k}")) as f:
                        f.write(row["raw"].encode())
                actions.append((path, None if row["raw"] is None else str(k)))
            folder.write(f"{own}/{ACTIONS}", json.dumps(actions).encode())
        except BaseException:
            folder.remove(own)
            raise
        return Staged(task, len(actions))

    def commit(self, messages: list[Staged | None]) -> None:
        """One record names the attempts that count; with it the write is done, whatever happens next."""
        folder = Folder(self.root)
        tasks = [m.task for m in messages if m is not None and m.files]
        folder.write(f"{STAGED}/{self.job}/{RECORD}", json.dumps(tasks).encode())
        if self.finish:
            for task in tasks:
                roll_forward(folder, self.job, task)
            folder.remove(f"{STAGED}/{self.job}")

    def abort(self, messages: list[Staged | None]) -> None:
        Folder(self.root).remove(f"{STAGED}/{self.job}")


class KnowledgeFiles(DataSource):
    """Writes rows (path, raw) as files under the `path` that is given; where raw is null the file goes to the trash.

    `finish` false leaves the moves to `finish`, which deals them out to tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "knowledge_files"

    def schema(self) -> str:
        return "path string, raw string"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if not {"path", "raw"} <= set(schema.fieldNames()):
            raise SinkError("rows need path and raw")
        if overwrite:
            raise SinkError("files are only added, replaced or trashed: use mode append")
        return FilesWriter(self.options["path"], self.options.get("finish", "true").lower() != "false")


def finish(spark: SparkSession, root: str) -> list[str]:
    """Complete all writes that are committed but not in place, each task folder by a task; the jobs that were completed."""
    folder = Folder(root)
    done = []
    for job in folder.names(STAGED):
        if folder.there(f"{STAGED}/{job}/{RECORD}"):
            tasks = json.loads(folder.read(f"{STAGED}/{job}/{RECORD}"))
            if tasks:
                x = spark.createDataFrame([(t,) for t in tasks], "task string").repartition(-(-len(tasks) // FOLDERS))
                x.foreachPartition(lambda rows, job=job: [roll_forward(Folder(root), job, r["task"]) for r in rows] and None)
            folder.remove(f"{STAGED}/{job}")
            done.append(job)
    return done


def save_files(files: DataFrame, root: str) -> str | None:
    """Write (path, raw) under `root`, a folder of a file system that driver and executors open; the name of the trash it may have filled.

    All files change or none do: rows are staged, one record commits them, tasks move them into place. Rows of one path
    meet in one task, which refuses two. Earlier writes that were committed but not completed are completed first.
    """
    spark = files.sparkSession
    spark.dataSource.register(KnowledgeFiles)
    finish(spark, root)
    files.select("path", "raw").repartition("path").write.format("knowledge_files").option("finish", "false").mode("append").save(root)
    return next(iter(finish(spark, root)), None)


def session_text(sessions: DataFrame) -> DataFrame:
    """(path, raw) of sessions: one JSON file each, by id."""
    columns = [c for c in sessions.columns if c != "modified"]
    return sessions.select(F.concat("id", F.lit(".json")).alias("path"), F.to_json(F.struct(*columns), {"pretty": "true"}).alias("raw"))


def save_sessions(sessions: DataFrame, root: str, now=None) -> str | None:
    """Sessions as `sources.exports.read_sessions` reads them, updated as of `now` (a column; by default the clock)."""
    stamp = F.current_timestamp() if now is None else now
    return save_files(session_text(sessions.withColumn("updated_at", stamp.cast("timestamp"))), root)
