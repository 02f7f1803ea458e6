"""Files as a sink: all or none, also where tasks fail, are tried again, or the writer dies between steps."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lexispark.sources import exports as X
from lexispark.sources import sink as K


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, raw string")


def tree(root):
    out = {}
    for folder, _, names in os.walk(root):
        for n in names:
            full = os.path.join(folder, n)
            out[os.path.relpath(full, root)] = open(full).read()
    return out


def test_replace_and_trash(spark, tmp_path):
    root = str(tmp_path)
    K.save_files(rows(spark, ("a/x.md", "one"), ("a/y.md", "two"), ("z.md", "")), root)
    assert tree(root) == {"a/x.md": "one", "a/y.md": "two", "z.md": ""}
    trash = K.save_files(rows(spark, ("a/x.md", "new"), ("a/y.md", None), ("none.md", None), ("b/ñ.md", "漢\n")), root)
    assert tree(root) == {"a/x.md": "new", "z.md": "", "b/ñ.md": "漢\n", f".trash/{trash}/a/x.md": "one", f".trash/{trash}/a/y.md": "two"}
    spark.dataSource.register(K.KnowledgeFiles)
    rows(spark, ("c.md", "3")).write.format("knowledge_files").mode("append").save(root)  # complete by itself
    assert tree(root)["c.md"] == "3" and not any(n.startswith(".staged") for n in tree(root))
    assert K.save_files(rows(spark), root) is not None and tree(root)["c.md"] == "3"


@pytest.mark.parametrize("bad", ["/etc/x", "../x", "a/../../x", "a//b", "", None, ".trash/x", ".staged/x"])
def test_bad_paths_leave_nothing(spark, tmp_path, bad):
    K.save_files(rows(spark, ("a.md", "old")), str(tmp_path))
    with pytest.raises(Exception, match="not a path"):
        K.save_files(rows(spark, ("a.md", "new"), ("b.md", "new"), (bad, "x")), str(tmp_path))
    assert tree(tmp_path) == {"a.md": "old"}


def test_failing_tasks_leave_nothing(spark, tmp_path):
    K.save_files(rows(spark, ("a.md", "old")), str(tmp_path))
    many = spark.range(0, 200, numPartitions=4).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 150, F.raise_error(F.lit("broken row"))).otherwise("x").alias("raw"))
    with pytest.raises(Exception, match="broken row"):
        K.save_files(many.unionByName(rows(spark, ("a.md", "new"))), str(tmp_path))
    assert tree(tmp_path) == {"a.md": "old"}
    with pytest.raises(Exception, match="two rows for a.md"):
        K.save_files(rows(spark, ("a.md", "1"), ("a.md", "2")), str(tmp_path))
    with pytest.raises(Exception, match="rows need path and raw"):
        spark.range(1).write.format("knowledge_files").mode("append").save(str(tmp_path))
    assert tree(tmp_path) == {"a.md": "old"}


def test_a_task_that_is_tried_again_counts_once(tmp_path):
    """Two attempts of a task stage their files; only the one whose message is committed comes into place."""
    from pyspark.sql import Row

    w = K.FilesWriter(str(tmp_path), finish=True)
    w.write(iter([Row(path="a.md", raw="first attempt")]))  # its message is lost
    second = w.write(iter([Row(path="a.md", raw="second attempt"), Row(path="b.md", raw="b")]))

    def dies():
        yield Row(path="c.md", raw="c")
        raise OSError("disk")

    with pytest.raises(OSError):
        w.write(dies())
    assert not os.path.exists(tmp_path / "a.md")
    w.commit([second, None])
    assert tree(tmp_path) == {"a.md": "second attempt", "b.md": "b"}
    w = K.FilesWriter(str(tmp_path), finish=True)
    w.abort([w.write(iter([Row(path="a.md", raw="x")])), None])
    assert tree(tmp_path) == {"a.md": "second attempt", "b.md": "b"}


def test_dying_between_the_moves(spark, tmp_path, monkeypatch):
    """After each number of steps the write is completed by the next one that comes along, and the old texts are in the trash."""
    real = {n: getattr(K.Folder, n) for n in ("move", "copy")}
    for steps in range(9):
        root = tmp_path / str(steps)
        K.save_files(rows(spark, ("a.md", "a"), ("b.md", "b"), ("c.md", "c")), str(root))
        w = K.FilesWriter(str(root), finish=False)
        from pyspark.sql import Row

        w.commit([w.write(iter([Row(path="a.md", raw="A"), Row(path="b.md", raw=None), Row(path="c.md", raw="C"), Row(path="d.md", raw="D")]))])
        left = [steps]

        def step(name, left=left):
            def run(self, *a):
                left[0] -= 1
                if left[0] < 0:
                    raise ZeroDivisionError
                return real[name](self, *a)

            return run

        task = json.loads((root / ".staged" / w.job / K.RECORD).read_text())[0]
        with monkeypatch.context() as m:
            for name in real:
                m.setattr(K.Folder, name, step(name))
            try:
                K.roll_forward(K.Folder(str(root)), w.job, task)
            except ZeroDivisionError:
                pass
        assert all((root / n).exists() for n in ("a.md", "c.md"))
        assert K.finish(spark, str(root)) == [w.job]
        assert tree(root) == {"a.md": "A", "c.md": "C", "d.md": "D"} | {f".trash/{w.job}/{n}.md": n for n in "abc"}


def test_sessions_come_back(spark, tmp_path):
    kind = "id string, started_at timestamp, provider string, messages array<struct<role:string,content:string>>, learnings_extracted int"
    s = spark.createDataFrame([("s1", None, "p", [("user", "q\n\"x\"")], 2), ("s2", None, "p", [], 0)], kind)
    K.save_sessions(s, str(tmp_path), F.lit("2025-05-05 01:02:03"))
    K.save_sessions(s.filter("id = 's1'").withColumn("provider", F.lit("other")), str(tmp_path), F.lit("2025-06-05 01:02:03"))
    got = {r["id"]: r for r in X.read_sessions(spark, str(tmp_path)).collect()}
    assert got["s1"]["provider"] == "other" and got["s1"]["messages"][0]["content"] == 'q\n"x"' and got["s2"]["updated_at"].month == 5 and len(got) == 2
