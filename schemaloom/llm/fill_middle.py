"""Fill-in-the-middle form of texts, cut by one counted pattern.

A text's units are runs of ASCII letters and single other code points. ``regexp_count`` gives their number
n; digests of the id draw two cuts a <= b from 0..n and the form. A pattern made for the row, with the
possessive counted groups unit{a} and unit{b-a}, captures prefix, middle and suffix in one match, and the
replacement puts them in order behind their marks. Possessive counted groups run as a loop in the matcher,
so neither long texts nor large counts need a deep stack.

Everything is a column expression of the row: no shuffle, no Python. Defined results: a null text is empty;
empty texts, and texts that hold a mark themselves, stay plain and so can always be rebuilt; a null id draws
from the digest of no digits; repeated rows give the same result each. Only the two named columns are read,
and the result has the columns listed at ``transform`` whatever else the input holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Shares of 100: from this draw on a text stays plain; below this draw the suffix comes first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
SEED = "1:"

# The pieces' order behind their marks, and the way back. Marks never stand in a cut text, so lazy groups end at the marks.
_FORMS = {"psm": (f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "$1$3$2"),
          "spm": (f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2", rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z", "$2$3$1")}


def draws(id_col: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2^32 from the digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def cut_pattern(a: Column, b: Column) -> Column:
    """The row's pattern: a units, b - a units, the rest."""
    unit = "((?:[A-Za-z]++|[^A-Za-z]){"
    return F.concat(F.lit(r"(?s)\A" + unit), a.cast("string"), F.lit("}+)" + unit), (b - a).cast("string"), F.lit(r"}+)(.*)\z"))


def restore(output: Column, form: Column) -> Column:
    """The text an output was made from."""
    text = output
    for name, (_, pattern, order) in _FORMS.items():
        text = F.when(form == name, F.regexp_replace(output, pattern, order)).otherwise(text)
    return text


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: str = SEED, plain_from: int = PLAIN_FROM,
              suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(id, n, form, output, prefix_chars, middle_chars); the last two are null where the text stays plain."""
    h1, h2, h3, h4 = draws(F.col("_id"), seed)
    marked = F.contains("_text", F.lit(PREFIX)) | F.contains("_text", F.lit(SUFFIX)) | F.contains("_text", F.lit(MIDDLE))
    form = (F.when((F.col("_text") == "") | marked | (F.col("_h3") % 100 >= plain_from), "plain")
            .when(F.col("_h4") % 100 < suffix_first, "spm").otherwise("psm"))
    order = F.when(F.col("form") == "spm", _FORMS["spm"][0]).otherwise(_FORMS["psm"][0])
    c1, c2 = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).select(
        "_id", "_text", h1.alias("_h1"), h2.alias("_h2"), h3.alias("_h3"), h4.alias("_h4"),
        F.regexp_count("_text", F.lit(UNIT)).cast("bigint").alias("n"))
    cut = rows.select("_id", "_text", "n", form.alias("form"), cut_pattern(F.least(c1, c2), F.greatest(c1, c2)).alias("_pattern"))
    made = cut.select("_id", "n", "form", F.when(F.col("form") == "plain", F.col("_text")).otherwise(
        F.regexp_replace("_text", F.col("_pattern"), order)).alias("output"))
    # the pieces' lengths are read off the output, so the text is matched once
    head = F.when(F.col("form") == "spm", F.substring_index(F.substring_index("output", MIDDLE, 1), PREFIX, -1)).otherwise(
        F.substr(F.substring_index("output", SUFFIX, 1), F.lit(len(PREFIX) + 1)))
    cut_only = F.col("form") != "plain"
    return made.select(
        F.col("_id").alias(id_col), "n", "form", "output",
        F.when(cut_only, F.length(head)).cast("bigint").alias("prefix_chars"),
        F.when(cut_only, F.length(F.substring_index("output", MIDDLE, -1))).cast("bigint").alias("middle_chars"))
