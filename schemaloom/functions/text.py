"""Scalar text functions. Every function takes and returns Columns and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as scripts see it: ASCII spaces, the Unicode spaces and the byte-order mark.
SPACES = (" \t\n\x0b\f\r\u00a0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")


def _blank() -> Column:
    return F.lit("")


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def trim_space(value) -> Column:
    return F.trim(as_col(value), F.lit(SPACES))


def has_text(value) -> Column:
    """Anything but spaces in it; stops at the first such character."""
    return as_col(value).rlike(r"[^\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def clean_scalar(value) -> Column:
    """Null becomes '', outer spaces go, and one matched pair of outer quotes goes."""
    text = trim_space(F.coalesce(as_col(value).cast("string"), _blank()))
    quoted = text.rlike(r"\A['\"`]")
    return F.when(quoted, trim_space(F.regexp_replace(text, r"(?s)\A(['\"`])(.*)\1\z", "$2"))).otherwise(text)


def first_text(*values) -> Column:
    """First value that is not blank after cleaning, else ''."""
    if len(values) == 1:
        return clean_scalar(values[0])
    filled = F.filter(F.array(*[clean_scalar(v) for v in values]), lambda x: x != "")
    return F.coalesce(F.get(filled, 0), _blank())


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def not_blank(value) -> Column:
    return clean_scalar(value) != ""


def test_name(value) -> Column:
    """Last dotted part of a declared test's name."""
    return F.substring_index(first_text(value), ".", -1)


def constraint_type(value) -> Column:
    return F.regexp_replace(F.lower(first_text(value)), r"[\s-]+", "_")


def strip_identifier(value) -> Column:
    return F.ltrim(F.rtrim(first_text(value), F.lit("`\"']")), F.lit("`\"'["))


def _strip_quotes(value: Column) -> Column:
    return F.ltrim(F.rtrim(trim_space(value), F.lit("`\"']")), F.lit("`\"'["))


def _head(value) -> Column:
    """First word of the text once closing semicolons are gone."""
    return F.regexp_extract(F.rtrim(first_text(value), F.lit(";")), r"\A(\S*)", 1)


def _parts(value: Column) -> Column:
    return F.filter(F.split(value, r"\."), lambda x: x != "")


def _last(parts: Column) -> Column:
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), _blank())


def relation_leaf(value) -> Column:
    text = trim_space(F.rtrim(first_text(value), F.lit(";")))
    return strip_identifier(_last(_parts(F.regexp_extract(text, r"\A(\S*)", 1))))


def normalize_relation(value) -> Column:
    parts = F.filter(F.transform(F.split(_head(value), r"\."), strip_identifier), lambda x: x != "")
    return F.lower(F.array_join(parts, "."))


def relation_tail(value) -> Column:
    """Last part of a rendered relation name, quotes off."""
    return _last(F.filter(F.transform(F.split(first_text(value), r"\."), _strip_quotes), lambda x: x != ""))


def safe_part(value) -> Column:
    return F.trim(F.regexp_replace(first_text(value), r"[\\/]+", "."), F.lit("."))


def string_list(values) -> Column:
    """Array of texts -> one array: commas split, identifiers stripped, blanks dropped."""
    values = as_col(values)
    items = F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")),
                                  lambda x: F.split(first_text(x), ",")))
    return F.filter(F.transform(items, strip_identifier), lambda x: x != "")


def _quoted_args(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(['\"])(.*?)\1"), F.lit(2)), trim_space)


def parse_call(value) -> Column:
    """``source('s','t')`` or ``ref('m')`` / ``ref('pkg','m')`` -> struct, null when neither."""

    def args(text, word):
        return _quoted_args(F.regexp_extract(text, rf"(?s)\b{word}\s*\((.*?)\)", 1))

    def call(kind, source_name, package, name):
        return F.struct(F.lit(kind).alias("kind"), source_name.alias("source_name"),
                        package.alias("package"), name.alias("name"))

    def choose(found):
        source, ref = found["source"], found["ref"]
        return (
            F.when(F.size(source) >= 2, call("source", F.get(source, 0), _blank(), F.get(source, 1)))
            .when(F.size(ref) >= 2, call("ref", _blank(), F.get(ref, 0), F.get(ref, 1)))
            .when(F.size(ref) == 1, call("ref", _blank(), _blank(), F.get(ref, 0)))
        )

    both = once(first_text(value), lambda text: F.struct(args(text, "source").alias("source"), args(text, "ref").alias("ref")))
    return once(both, choose)


def call_label(call) -> Column:
    """Text kept for a call that resolves to nothing."""
    call = as_col(call)
    return F.coalesce(
        F.when(call["kind"] == "source", F.concat_ws(".", call["source_name"], call["name"]))
        .otherwise(call["name"]),
        _blank(),
    )


def constraint_target(value) -> Column:
    """``REFERENCES x (a, b) ON DELETE ..`` or ``x (a, b)`` -> struct(leaf, relation, columns)."""
    text = F.regexp_replace(first_text(value), r"(?is)\A.*?\breferences\s+", "")
    text = trim_space(F.regexp_replace(
        text, r"(?is)\s+\b(on\s+(delete|update)|deferrable|not\s+deferrable)\b.*\z", ""))
    tail = r"\(([^()]*)\)\s*\z"

    def parts(text):
        head = trim_space(F.regexp_replace(text, tail, ""))
        return F.struct(relation_leaf(head).alias("leaf"), normalize_relation(head).alias("relation"),
                        string_list(F.array(F.regexp_extract(text, tail, 1))).alias("columns"))

    return once(text, parts)


def physical_name(kind, alias, identifier, relation_name, name, unique_id) -> Column:
    """Name of the object in the warehouse; sources have no alias."""
    tail = F.substring_index(as_col(unique_id), ".", -1)
    return F.when(
        as_col(kind) == "source", first_text(identifier, relation_tail(relation_name), name, tail)
    ).otherwise(first_text(alias, identifier, relation_tail(relation_name), name, tail))


def entry_base_name(kind, source_name, name) -> Column:
    source = first_text(source_name)
    return F.when((as_col(kind) == "source") & (source != ""),
                  F.concat(source, F.lit("."), first_text(name))).otherwise(first_text(name))


def pretty_type(value) -> Column:
    """Lower-case type word, spaces out of the rest."""
    value = F.coalesce(as_col(value), _blank())
    word = F.regexp_extract(value, r"\A([a-zA-Z_]+)", 1)
    rest = F.regexp_replace(value, r"\A[a-zA-Z_]+", "")
    return F.when(word == "", F.lower(value)).otherwise(
        F.concat(F.lower(word), F.regexp_replace(rest, r"\s+", "")))


def unquote(value) -> Column:
    """One opening and one closing quote or bracket off."""
    text = trim_space(value)
    return F.regexp_replace(F.regexp_replace(text, r"\A[`\"\[]", ""), r"[`\"\]]\z", "")


def bare_name(value) -> Column:
    return unquote(F.substring_index(as_col(value), ".", -1))


def snake_case(value) -> Column:
    return F.lower(F.regexp_replace(as_col(value), r"([a-z0-9])([A-Z])", "$1_$2"))


def mermaid_name(value) -> Column:
    value = as_col(value)
    return F.when(value.rlike(r"\A[A-Za-z_]\w*\z"), value).otherwise(quote(value))


def mermaid_type(value) -> Column:
    token = F.regexp_replace(F.regexp_replace(trim_space(F.coalesce(as_col(value), _blank())), r"\s+", "_"),
                             r"[^\w(),]", "")
    return F.when(token == "", F.lit("unknown")).otherwise(token)


def dbml_type(value) -> Column:
    value = F.coalesce(as_col(value), _blank())
    text = trim_space(value)
    return (F.when(value == "", F.lit("unknown"))
            .when(text.rlike(r"\A[\w()]+\z"), text).otherwise(quote(text)))


def quote(value) -> Column:
    return F.concat(F.lit('"'), F.replace(as_col(value), F.lit('"'), _blank()), F.lit('"'))


def json_quote(value) -> Column:
    """JSON string literal of a text."""
    text = F.to_json(F.struct(as_col(value).alias("v")))
    return F.substring(text, F.lit(6), F.length(text) - 6)


def json_script_escape(value) -> Column:
    """JSON text safe inside a script element."""
    return F.replace(as_col(value), F.lit("<"), F.lit("\\u003c"))


def singular_key(value) -> Column:
    return F.regexp_replace(as_col(value), r"(es|s)\z", "")


def fk_stem(value) -> Column:
    """``<foo>_id`` / ``<foo>id`` -> foo; '' when the name has another form."""
    return F.regexp_extract(F.lower(as_col(value)), r"\A(.+?)_?id\z", 1)


def json_text_list(value) -> Column:
    """A field that holds one text or a list of texts, read as JSON text -> array."""
    value = as_col(value)
    parsed = F.when(value.startswith("["), F.from_json(value, "array<string>"))
    return F.coalesce(parsed, F.when(value.isNotNull(), F.array(value)), F.array().cast("array<string>"))
