import pytest
from pyspark.sql import functions as F

from lexispark.functions import text as T

STEMS = {
    "running": "runn", "creation": "crea", "slowly": "slow", "played": "play", "player": "play", "fastest": "fast", "happiness": "happi", "movement": "move",
    "readable": "read", "flexible": "flex", "companies": "compan", "tools": "tool", "go": "go", "a": "a", "CLI": "cli", "testing!": "test",
}


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("x")).first()["x"]


def test_stems_and_tokens(spark):
    text = " ".join(STEMS)
    assert one(spark, T.stems(F.col("t")), t=text) == list(STEMS.values()) == T.query_terms(text)
    assert one(spark, T.tokens(F.col("t")), t="Some like  tea, not \"Cold\" milk! -- ...") == ["some", "like", "tea", "not", "cold", "milk"]
    assert one(spark, T.tokens(F.col("t")), t="") == []


def test_chunks(spark):
    w = lambda n: " ".join(["w"] * n)
    cases = {
        "": [""], f"{w(150)}\n\n{w(50)}": [f"{w(150)}\n\n{w(50)}"], f"{w(150)}\n\n{w(51)}": [w(150), w(51)], w(200): [w(200)], w(201): [w(200), "w"],
        f"a\n\n{w(450)}\n\nb": ["a", w(200), w(200), w(50), "b"], "é ü\n\n \n\n漢": ["é ü\n\n漢"],
    }
    for text, want in cases.items():
        assert one(spark, T.chunks(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, days", [("7d", 7), ("30d", 30), ("1w", 7), (" 2W ", 14), ("invalid", None), ("0d", None), ("0w", None), ("", None), ("1.5d", None)])
def test_since(spark, text, days):
    assert one(spark, T.since_days(F.col("t")), t=text) == days


def test_tasks(spark):
    text = "x\n- [ ] a [x] b\n  - [~] \U0001f534 c\n- [x] d"
    assert [tuple(r) for r in one(spark, T.parse_tasks(F.col("t")), t=text)] == [("a [x] b", False, ""), ("\U0001f534 c", False, "high"), ("d", True, "")]
    assert one(spark, T.toggle_task(F.col("t"), F.lit(0), F.lit(True)), t=text).split("\n")[1] == "- [x] a [x] b"
    assert one(spark, T.toggle_task(F.col("t"), F.lit(3), F.lit(True)), t=text) is None
    assert one(spark, T.remove_task(F.col("t"), F.lit(1)), t=text) == "x\n- [ ] a [x] b\n- [x] d"
    assert one(spark, T.append_task(F.col("t"), F.lit("e"), F.lit("low")), t=text) == text + "\n- [ ] \U0001f7e2 e\n"


def test_goals(spark):
    text = "- [ ] [short] a\n- [x] [x] b"
    assert [tuple(r) for r in one(spark, T.parse_goals(F.col("t")), t=text)] == [("a", "short", False), ("b", "x", True)]
    assert one(spark, T.toggle_goal(F.col("t"), F.lit(1), F.lit(False)), t=text) == "- [ ] [short] a\n- [ ] [x] b"
    assert one(spark, T.append_goal(F.col("t"), F.lit("c"), F.lit("")), t="a\n") == "a\n- [ ] [medium] c\n"


def test_tables_and_json(spark):
    assert one(spark, T.escape_cell(F.col("t")), t=" a\r\nb  <i>|&") == "a b &lt;i&gt;\\|&amp;"
    rows = F.array(F.array(F.lit("1")), F.array(F.lit("2"), F.lit("3"), F.lit("4")))
    assert one(spark, T.markdown_table(F.array(F.lit("h"), F.lit("k")), rows), t="") == "| h | k |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |\n"
    assert one(spark, T.json_array(F.col("t")), t='ok: ["a]\\"", [1]] and [2]') == '["a]\\"", [1]]'
    assert one(spark, T.json_array(F.col("t")), t=" none ") == "none"


def test_auto_tags_and_symbols(spark):
    assert one(spark, T.auto_tags(F.col("t")), t="# Big Table: the big\nFast query plans work\n## Table") == ["big", "table", "fast-query", "plans-work", "query-plans"]
    go = "package x\nfunc New() {}\nfunc (u *User) Greet() {}\ntype User struct {}"
    assert [(s["name"], s["kind"]) for s in one(spark, T.symbols(F.col("t"), "go"), t=go)] == [("New", "func"), ("Greet", "method"), ("User", "type")]


def test_json_array_folds_over_brackets_only(spark):
    """A long text costs what its brackets cost: a fold over its characters took minutes. Strings without end, escapes and other planes too."""
    import time

    body = '["' + "x \\\" ] " * 400_000 + '", [1, "\U0001f600"], {}]'
    cases = {body + " tail]": body, '["open ] ': '["open ] ', "[a]]": "[a]", '] ["\\\\"] x': '["\\\\"]', "[[]": "[[]", '["\U0001f600"] y': '["\U0001f600"]', "a\n[1,\n2] b": "[1,\n2]"}
    began = time.time()
    for text, want in cases.items():
        assert one(spark, T.json_array(F.col("t")), t=text) == want.strip()
    assert time.time() - began < 30


def test_auto_tags_counts_each_word_once(spark):
    """All words of all headings were computed anew for each tag, so the work grew with the square of a text's words."""
    import time

    text = "".join(f"# w{i:04d} w{i % 7:04d}\n" for i in range(1500))
    began = time.time()
    assert one(spark, T.auto_tags(F.col("t")), t=text) == [f"w{i:04d}" for i in range(5)]
    assert one(spark, T.auto_tags(F.col("t")), t="") == []
    assert time.time() - began < 20


def test_small_rows_are_spread(spark):
    from lexispark.runtime import spread

    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_chunks_of_a_long_paragraph(spark):
    """The words of a paragraph were split anew for each of its chunks, so a long one took the square of its length."""
    import time

    text = " ".join(f"w{i}" for i in range(200_000))
    began = time.time()
    got = one(spark, F.transform(T.chunks(F.col("t")), lambda c: F.size(F.split(c, " "))), t=text)
    assert got == [200] * 1000 and time.time() - began < 20
