"""Fill-in-the-middle against a plain pass over code points, and the exact way back."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from schemaloom.llm import fill_middle

SCHEMA = "doc_id bigint, text string, n bigint, form string, output string, _text int"
TEXTS = [None, "", "a", "abc", " ", "\n\n", "ab cd-ef 12", "x<P>y", "<S>", "<M> z", "a<S", "<P", "<", "P>", "né Ünï 😀😀 tail", "😀", "$1 \\1 {3}",
         "line\r\nline end\x85", "a" * 50_000, "a1" * 150_000, "\x00mid\x00"]


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", text, None, None
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return len(units), form, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def check(spark, rows):
    frame = spark.createDataFrame([(i, t, 7, "x", "y", 1) for i, t in rows], SCHEMA)
    made = fill_middle.transform(frame).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    got = sorted(((r["doc_id"], r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"], r["back"]) for r in made), key=repr)
    assert got == sorted(((i, *plain(i, t), t or "") for i, t in rows), key=repr)


def test_odd_texts_under_many_ids(spark):
    check(spark, [(i * 31 + k, t) for k in range(6) for i, t in enumerate(TEXTS)] + [(None, "null id here"), (5, "same row"), (5, "same row")])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**12), st.text("ab1 <PSM>é😀\n$\\", max_size=30)), min_size=1, max_size=60))
def test_any_text(spark, rows):
    check(spark, rows)


def test_empty_table_and_settings(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fill_middle.transform(none).count() == 0
    rows = spark.createDataFrame([(i, "one two three") for i in range(300)], "k bigint, body string")
    forms = {r["form"] for r in fill_middle.transform(rows, "k", "body", seed="s/", plain_from=100, suffix_first=100).collect()}
    assert forms == {"spm"}


def test_one_pass_in_the_jvm(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    plan = fill_middle.transform(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
