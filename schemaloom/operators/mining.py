"""Tables, columns, keys and edges out of script texts, one script per row.

Splitting needs to know which separators stand outside quotes and brackets. A pattern answers that
for text nested up to ``DEPTH`` levels, at the speed of the regex engine. Anything deeper or unbalanced
goes through a fold over the text's tokens that follows the bracket depth and has no limit. Both work
inside the script's own row: nothing is shuffled until columns meet their keys. Scripts are never
shortened.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bare_name, has_text, pretty_type, trim_space, unquote

# Format rules, first match wins. A rule is a list of patterns that must all be found.
FORMAT_RULES = (
    ("mermaid", (r"(?m)^\s*erDiagram\b",)),
    ("plantuml", (r"@startuml\b",)),
    ("plantuml", (r'\b(entity|class)\s+("?\w)', r"\|\|--|\}o|--\{|<<PK>>")),
    ("dbml", (r"(?m)^\s*Table\s+[^\s{]+\s*\{",)),
    ("dbml", (r"(?m)^\s*Ref\b[^:]*:",)),
    ("prisma", (r"(?m)^\s*model\s+\w+\s*\{",)),
    ("prisma", (r"\b(datasource|generator)\s+\w+\s*\{",)),
    ("sequelize", (r"\.define\s*\(\s*['\"]",)),
    ("sequelize", (r"DataTypes\.", r"\.init\s*\(")),
    ("sqlalchemy", (r"\bColumn\s*\(|mapped_column\s*\(",
                    r"\b(Base|db\.Model|DeclarativeBase|declarative_base|__tablename__)\b")),
    ("bigquery", (r"(?i)^\s*with\b", r"`[^`]+\.[^`]+`")),
)
# Texts of which every match of a rule's pattern holds one.
LITERALS = {
    r"(?m)^\s*erDiagram\b": ("erDiagram",), r"@startuml\b": ("@startuml",), r'\b(entity|class)\s+("?\w)': ("entity", "class"),
    r"(?m)^\s*Table\s+[^\s{]+\s*\{": ("Table",), r"(?m)^\s*Ref\b[^:]*:": ("Ref",), r"(?m)^\s*model\s+\w+\s*\{": ("model",),
    r"\b(datasource|generator)\s+\w+\s*\{": ("datasource", "generator"), r"\.define\s*\(\s*['\"]": (".define",),
    r"DataTypes\.": ("DataTypes.",), r"\bColumn\s*\(|mapped_column\s*\(": ("Column", "mapped_column"),
    r"`[^`]+\.[^`]+`": ("`",),
}
# Clause patterns.
CREATE = (r"(?i)create\s+(?:or\s+replace\s+)?(?:temporary\s+|temp\s+|transient\s+|volatile\s+)?"
          r"table\s+(?:if\s+not\s+exists\s+)?")
ALTER_ADD = r"(?i)alter\s+table\s+(?:only\s+)?([^\s(]+(?:\.[^\s(]+)?)\s+add\s+"
REFERENCES = r"(?i)references\s+([^\s(]+(?:\.[^\s(]+)?)\s*(\(([^)]*)\))?"
FOREIGN_KEY = r"(?i)foreign\s+key\s*\(([^)]*)\)\s*references\s+([^\s(]+(?:\.[^\s(]+)?)\s*(\(([^)]*)\))?"
SKIPPED_HEADS = ("key", "index", "check", "fulltext", "spatial")

# Quoted text runs to its quote, a backslash in front of the quote keeps it open.
_QUOTED = "|".join(rf"{q}[^{q}]*+(?:(?<=\\){q}[^{q}]*+)*+(?:{q}|\z)" for q in "'\"`")
_BLOCK = r"/\*(?s:.*?)(?:\*/|\z)"
_WORD = r"`[^`]*`?|\"[^\"]*\"?|\[[^\]]*\]?|[^\s(,]+"
# One bracket group, up to four levels; deeper type arguments are folded.
_GROUP = r"\((?:[^()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))*+\)"


# Nesting the patterns follow; deeper text is folded.
DEPTH = 12


def _nested(depth: int, opens: str = "(", shuts: str = ")") -> str:
    """A bracket group with up to ``depth`` groups inside each other.

    Every repeat is possessive: the engine never backtracks into it and runs it as a loop, so long
    texts need no deep stack.
    """
    inside = "" if depth == 0 else "|" + _nested(depth - 1, opens, shuts)
    opens, shuts = (re.escape(b) for b in (opens, shuts))
    return rf"[{opens}](?:[^'\"`{opens}{shuts}]++|{_QUOTED}{inside})*+[{shuts}]"


# Step between statements in the place of an item: both are 31-bit numbers.
IN_STATEMENT = 1 << 31
_GROUPS = _nested(DEPTH)
# The same for round and square brackets, which count alike in a select list.
_ANY_GROUPS = _nested(DEPTH, "([", ")]")
_ANY_BALANCED = rf"(?s)\A(?:[^'\"`()\[\]]++|{_QUOTED}|{_ANY_GROUPS})*+\z"
_ANY_PIECE = rf"(?s)(?:[^'\"`()\[\],]++|{_QUOTED}|{_ANY_GROUPS})++"
_BALANCED = rf"(?s)\A(?:[^'\"`()]++|{_QUOTED}|{_GROUPS})*+\z"
_BODY = rf"(?s)\A[^(]*+\(((?:[^'\"`()]++|{_QUOTED}|{_GROUPS})*+)\)"


def _piece(separator: str) -> str:
    """A run of text without the separator, groups and quoted text taken whole."""
    return rf"(?s)(?:[^'\"`(){separator}]++|{_QUOTED}|{_GROUPS})++"


def classify_format(text) -> Column:
    """Format of a script text."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    result = None
    for name, patterns in FORMAT_RULES:
        rule = None
        for pattern in patterns:
            # every match holds one of these texts: a search for them is much cheaper than the pattern
            for k, part in enumerate(LITERALS.get(pattern, ())):
                some = F.contains(text, F.lit(part)) if k == 0 else some | F.contains(text, F.lit(part))
            found = some & text.rlike(pattern) if pattern in LITERALS else text.rlike(pattern)
            rule = found if rule is None else rule & found
        result = F.when(rule, name) if result is None else result.when(rule, name)
    return result.otherwise("sql")


def _tokens(text, marks: str, comments: str = "") -> Column:
    """Text -> tokens: each mark alone, comments as a space, quoted text never split."""
    special = "".join(f"\\{c}" for c in marks)
    alone = [f"[{special}]"] if marks else []
    run = [rf"[^'\"`{special}]++", _QUOTED]
    if comments:
        starts = "#" if "#" in comments else ""
        run = [rf"[^'\"`\-/{starts}{special}]++", _QUOTED, r"-(?!-)", r"/(?!\*)"]
    pattern = "(?s)" + "|".join([*([comments] if comments else []), *alone, f"(?:{'|'.join(run)})++"])
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if not comments:
        return tokens
    return F.transform(tokens, lambda x: F.when(x.rlike(rf"\A(?:{comments})"), " ").otherwise(x))


def _depth_step(token: Column, brackets: str) -> Column:
    return (F.when(token.isin(*brackets[::2]), 1).when(token.isin(*brackets[1::2]), -1).otherwise(0))


def _text(tokens: Column, start: Column, end: Column) -> Column:
    """Tokens from start up to end (0-based, end excluded) as text."""
    return F.array_join(F.slice(tokens, start + 1, end - start), "")


def _split(tokens: Column, separator: str, brackets: str = "()") -> Column:
    """Tokens -> texts between separators that stand outside all brackets."""
    zero = F.lit(0)
    spans = "array<struct<start:int,end:int>>"
    begin = F.struct(zero.alias("at"), zero.alias("depth"), zero.alias("start"),
                     F.array().cast(spans).alias("spans"))

    def step(state, token):
        depth = state["depth"] + _depth_step(token, brackets)
        cut = (token == separator) & (depth == 0)
        span = F.struct(state["start"].alias("start"), state["at"].alias("end"))
        return F.struct(
            (state["at"] + 1).alias("at"), depth.alias("depth"),
            F.when(cut, state["at"] + 1).otherwise(state["start"]).alias("start"),
            F.when(cut, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(tokens, begin, step, lambda s: F.array_append(
        s["spans"], F.struct(s["start"].alias("start"), s["at"].alias("end"))))
    return F.transform(spans, lambda p: _text(tokens, p["start"], p["end"]))


def _first_group(tokens: Column) -> Column:
    """Places of the first opening bracket and of the one that closes it; -1 when missing."""
    none = F.lit(-1)
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), none.alias("open"), none.alias("close"))

    def step(state, token):
        depth = state["depth"] + _depth_step(token, "()")
        return F.struct(
            (state["at"] + 1).alias("at"), depth.alias("depth"),
            F.when((state["open"] < 0) & (token == "("), state["at"]).otherwise(state["open"]).alias("open"),
            F.when((state["close"] < 0) & (token == ")") & (depth == 0), state["at"]).otherwise(
                state["close"]).alias("close"))

    return F.aggregate(tokens, begin, step)


def ddl_statements(scripts: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """(ids, stmt, sql): comments blanked, split on ';' outside quotes and brackets.

    ``stmt`` grows in script order.
    """
    comments = rf"--[^\n]*+|#[^\n]*+|{_BLOCK}"
    clean = scripts.select(*ids, F.array_join(_tokens(F.col(text), "", comments), "").alias("clean"))
    pieces = F.when(F.col("clean").rlike(_BALANCED), F.regexp_extract_all("clean", F.lit(_piece(";")), F.lit(0)))
    # the tokens of the fold get a column of their own: in its lambdas they would be cut again per slice
    tokens = F.when(F.col("pieces").isNull(), _tokens(F.col("clean"), "();"))
    return (
        clean.withColumn("pieces", pieces).withColumn("tokens", tokens)
        # the outer form: the plain one makes the optimizer test the array first, computing it twice
        .select(*ids, F.posexplode_outer(F.coalesce("pieces", _split(F.col("tokens"), ";"))).alias("stmt", "sql"))
        .withColumn("stmt", F.col("stmt").cast("bigint")).where(has_text("sql"))
    )


def ddl_bodies(statements: DataFrame, ids: list[str]) -> DataFrame:
    """Statements that create a table: (ids, stmt, name, body, closed). Tables, items and errors read these."""
    # what stands behind the clause and the closed body are found by one search each; the outer explode
    # keeps them from being computed again in the conditions
    after = F.explode_outer(F.array(F.regexp_extract("sql", rf"(?s){CREATE}(.*)", 1)))
    raw = F.regexp_extract(F.substring_index("after", "(", 1), r"(\S+)", 1)
    tokens, group, whole = F.col("tokens"), F.col("group"), F.col("whole")
    opening = F.instr("whole", "(")
    return (
        statements.select(*ids, "stmt", after.alias("after")).where(F.contains("after", F.lit("(")))
        .select(*ids, "stmt", "after", F.explode_outer(F.array(raw)).alias("raw")).where("raw <> ''")
        .select(*ids, "stmt", bare_name("raw").alias("name"), "after", F.regexp_extract("after", _BODY, 0).alias("whole"))
        .withColumn("tokens", F.when(whole == "", _tokens(F.col("after"), "()")))
        .withColumn("group", F.when(whole == "", _first_group(tokens)))
        .select(*ids, "stmt", "name",
                F.when(whole != "", F.substring("whole", opening + 1, F.length("whole") - opening - 1)).otherwise(
                    F.when(group["close"] >= 0, _text(tokens, group["open"] + 1, group["close"]))).alias("body"))
        .withColumn("closed", F.col("body").isNotNull())
    )


def ddl_tables(bodies: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, table_key, name, stmt): first spelling of each table that has a closed body."""
    return bodies.where("closed").groupBy(*ids, F.lower("name").alias("table_key")).agg(
        F.min_by("name", "stmt").alias("name"), F.min("stmt").alias("stmt"))


def ddl_errors(bodies: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, stmt, name, error): bodies that never close."""
    return bodies.where("not closed").select(*ids, "stmt", "name", F.lit("unbalanced parentheses").alias("error"))


def ddl_items(bodies: DataFrame, ids: list[str]) -> DataFrame:
    """Comma-separated items of table bodies with their role: column, pk, unique, foreign or skip."""
    body = F.col("body")
    pieces = F.when(body.rlike(_BALANCED), F.regexp_extract_all(body, F.lit(_piece(",")), F.lit(0)))
    tokens = F.when(F.col("pieces").isNull(), _tokens(body, "(),"))
    items = (
        # an open body has no pieces and leaves with the blank items
        bodies.withColumn("pieces", pieces).withColumn("tokens", tokens)
        .select(*ids, "stmt", "name", F.posexplode_outer(
            F.coalesce("pieces", _split(F.col("tokens"), ","))).alias("item_no", "item"))
        .where(has_text("item"))
    )
    head = F.regexp_extract("item", rf"\A\s*({_WORD})", 1)
    rest = F.regexp_replace("item", rf"\A\s*(?:{_WORD})", "")
    # both words are columns of their own: the rules below name them many times
    word, second = F.col("word"), F.col("word2")
    has = F.col("item").rlike
    role = (
        F.when((word == "primary") & second.rlike("(?i)key"), "pk")
        .when(word == "unique", "unique")
        .when((word == "foreign") & second.rlike("(?i)key"), "foreign")
        .when((word == "constraint") & has(r"(?i)foreign\s+key"), "foreign")
        .when((word == "constraint") & has(r"(?i)primary\s+key"), "pk")
        .when((word == "constraint") | word.isin(*SKIPPED_HEADS) | (word == ""), "skip")
        .otherwise("column"))
    bracket = F.contains("rest", F.lit("("))
    group = F.when(bracket, F.regexp_extract("rest", rf"\A\s*(?:{_WORD})\s*({_GROUP})", 1)).otherwise("")
    opens_group = F.col("rest").rlike(rf"\A\s*(?:{_WORD})\s*\(")
    # arguments that nest deeper than the pattern are found by the fold, to any depth
    behind = F.regexp_replace("rest", rf"\A\s*(?:{_WORD})\s*", "")
    found = F.col("found")
    return (
        items.withColumn("head", head).withColumn("rest", rest)
        .withColumn("word", F.lower(unquote("head"))).withColumn("word2", F.regexp_extract("rest", rf"\A\s*({_WORD})", 1))
        .withColumn("role", role).withColumn("group", group)
        .withColumn("tokens", F.when((F.col("role") == "column") & (F.col("group") == "") & bracket & opens_group, _tokens(behind, "()")))
        .withColumn("found", F.when(F.col("tokens").isNotNull(), _first_group(F.col("tokens"))))
        .withColumn("group", F.when(found["close"] >= 0, _text(F.col("tokens"), found["open"], found["close"] + 1)).otherwise(F.col("group")))
        .drop("tokens", "found", "word")
        # place in the script: statements first, items inside
        .withColumn("at", F.col("stmt").cast("bigint") * F.lit(IN_STATEMENT) + F.col("item_no"))
        .withColumn("table_key", F.lower("name"))
    )


def _key_refs(items: DataFrame, ids: list[str]) -> DataFrame:
    """Columns listed by table-level key clauses: (ids, table_key, role, at, col_key)."""
    inner = F.regexp_extract("item", rf"(?s)\A[^(]*+({_GROUPS})", 1)
    # the first balanced group; deeper ones reach from the first bracket to the last
    listed = F.when(inner != "", inner.substr(F.lit(2), F.length(inner) - 2)).otherwise(
        F.regexp_extract("item", r"(?s)\((.*)\)", 1))
    pieces = F.when(F.col("listed").rlike(_BALANCED), F.regexp_extract_all("listed", F.lit(_piece(",")), F.lit(0)))
    tokens = F.when(F.col("pieces").isNull(), _tokens(F.col("listed"), "(),"))
    return (
        items.where(F.col("role").isin("pk", "unique")).withColumn("listed", listed)
        .withColumn("pieces", pieces).withColumn("tokens", tokens)
        .select(*ids, "table_key", "role", "at", F.explode(F.coalesce("pieces", _split(F.col("tokens"), ","))).alias("part"))
        .select(*ids, "table_key", "role", "at",
                F.lower(bare_name(F.regexp_extract("part", r"(\S+)", 1))).alias("col_key"))
        .where("col_key <> ''")
    )


def _attached(cols: DataFrame, refs: DataFrame, ids: list[str]) -> DataFrame:
    """Columns and references to columns in one table, each with ``col_at``: a column's own place, a reference's last column
    of its name before it. Rows are dealt out once, by table; references without an id point at nothing."""
    named = refs.where(" and ".join(f"`{i}` is not null" for i in ids))
    rows = cols.withColumn("role", F.lit(None).cast("string")).unionByName(named, allowMissingColumns=True).repartition(*ids, "table_key")
    before = W.partitionBy(*ids, "table_key", "col_key").orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    is_col = F.col("role").isNull()
    return rows.withColumn("col_at", F.max(F.when(is_col, F.col("at"))).over(before)).withColumn(
        "col_at", F.when(is_col, F.col("at")).otherwise(F.col("col_at"))).where(F.col("col_at").isNotNull())


def ddl_keys(items: DataFrame, ids: list[str]) -> DataFrame:
    """Flags set by key clauses on columns defined before them: (ids, table_key, col_at, pk, uniq)."""
    cols = _raw_columns(items, ids).select(*ids, "table_key", F.lower("col_name").alias("col_key"), "at")
    return (
        _attached(cols, _key_refs(items, ids), ids).where("role is not null")
        .groupBy(*ids, "table_key", "col_at")
        .agg(F.bool_or(F.col("role") == "pk").alias("key_pk"), F.bool_or(F.col("role") == "unique").alias("key_uniq"))
    )


def _raw_columns(items: DataFrame, ids: list[str]) -> DataFrame:
    lower = F.col("lower")
    starts_group = F.col("rest").rlike(r"\A\s*\(")
    type_raw = F.when(starts_group, "").otherwise(F.concat(unquote("word2"), F.col("group")))
    # a search for the word itself rules most items out
    return (
        items.where(F.col("role") == "column").withColumn("col_name", bare_name("head")).where("col_name <> ''")
        .withColumn("lower", F.lower("item")).withColumn("type_raw", type_raw).select(
            *ids, "table_key", F.col("name").alias("table_name"), "at", "item", "col_name",
            pretty_type("type_raw").alias("type"), "type_raw",
            (F.contains(lower, F.lit("primary")) & lower.rlike(r"\bprimary\s+key\b")).alias("pk"),
            (F.contains(lower, F.lit("null")) & lower.rlike(r"\bnot\s+null\b")).alias("nn"),
            (F.contains(lower, F.lit("unique")) & lower.rlike(r"\bunique\b")).alias("uniq"),
            (F.contains(lower, F.lit("references")) & F.col("item").rlike(REFERENCES)).alias("inline_fk")))


def ddl_columns(items: DataFrame, ids: list[str], relations: DataFrame | None = None) -> DataFrame:
    """(ids, table_key, at, name, type, pk, nn, uniq[, fk]) with the key clauses applied."""
    cols = _raw_columns(items, ids).select(
        *ids, "table_key", "at", F.lower("col_name").alias("col_key"), F.col("col_name").alias("name"), "type", "pk", "nn", "uniq", "inline_fk")
    refs = _key_refs(items, ids)
    if relations is not None:
        # behind every item: a name defined twice means its last column
        refs = refs.unionByName(relations.select(
            *ids, F.lower("from_table").alias("table_key"), F.lit("fk").alias("role"), F.lit((1 << 63) - 1).alias("at"),
            F.explode("from_cols").alias("c")).withColumn("col_key", F.lower("c")).drop("c"))
    of_column = W.partitionBy(*ids, "table_key", "col_at")

    def named(role: str) -> Column:
        return F.bool_or(F.coalesce(F.col("role") == role, F.lit(False))).over(of_column)

    flags = [named("pk").alias("key_pk"), named("unique").alias("key_uniq"), named("fk").alias("key_fk")]
    found = _attached(cols, refs, ids).select("*", *flags).where("role is null").select(
        *ids, "table_key", "at", "name", "type", (F.col("pk") | F.col("key_pk")).alias("pk"), "nn",
        (F.col("uniq") | F.col("key_uniq")).alias("uniq"), (F.col("inline_fk") | F.col("key_fk")).alias("fk"))
    return found.drop("fk") if relations is None else found


def _names(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), bare_name), lambda x: x != "")


def _fk(text: str, from_table) -> list[Column]:
    return [from_table.alias("from_table"), _names(F.regexp_extract(text, FOREIGN_KEY, 1)).alias("from_cols"),
            bare_name(F.regexp_extract(text, FOREIGN_KEY, 2)).alias("to_table"),
            _names(F.regexp_extract(text, FOREIGN_KEY, 4)).alias("to_cols")]


def ddl_foreign_keys(statements: DataFrame, items: DataFrame, tables: DataFrame, ids: list[str]) -> DataFrame:
    """Inline, table-level and ALTER TABLE foreign keys; unknown targets kept, no dedup.

    ``tables`` as of ``ddl_tables``: edges from tables no script creates are dropped.
    """
    inline = (
        items.where((F.col("role") == "column") & F.contains(F.lower("item"), F.lit("references")) & F.col("item").rlike(REFERENCES))
        .withColumn("col_name", bare_name("head"))
        .select(*ids, "at", F.col("name").alias("from_table"), F.array("col_name").alias("from_cols"),
                bare_name(F.regexp_extract("item", REFERENCES, 1)).alias("to_table"),
                _names(F.regexp_extract("item", REFERENCES, 3)).alias("to_cols"))
    )
    table_level = (items.where((F.col("role") == "foreign") & F.col("item").rlike(FOREIGN_KEY))
                   .select(*ids, "at", *_fk("item", F.col("name"))))
    tail = F.substring("sql", F.regexp_instr("sql", F.lit(ALTER_ADD))
                       + F.length(F.regexp_extract("sql", ALTER_ADD, 0)), F.length("sql"))
    altered = (
        statements.where(~F.col("sql").rlike(CREATE) & F.col("sql").rlike(ALTER_ADD))
        .withColumn("tail", tail).where(F.col("tail").rlike(FOREIGN_KEY))
        .select(*ids, (F.col("stmt").cast("bigint") * F.lit(IN_STATEMENT)).alias("at"),
                *_fk("tail", bare_name(F.regexp_extract("sql", ALTER_ADD, 1))))
    )
    raw = inline.unionByName(table_level).unionByName(altered)
    names = tables.select(*ids, "table_key", F.col("name").alias("known"))
    return (
        raw.withColumn("table_key", F.lower("from_table")).join(names, [*ids, "table_key"])
        .withColumn("from_table", F.col("known")).drop("known", "table_key")
        .withColumn("table_key", F.lower("to_table")).join(names, [*ids, "table_key"], "left")
        .select(*ids, "at", "from_table", "from_cols", F.coalesce("known", "to_table").alias("to_table"), "to_cols",
                F.col("known").isNull().alias("to_missing"))
    )


def _bare_id(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(trim_space(text), r"\A`|`\z", ""), r"\A\"|\"\z", "")
    return trim_space(F.substring_index(text, ".", -1))


def _groups(text: Column, tokens: Column) -> Column:
    """Outermost bracket groups with the text in front: array of (head, body, closed)."""
    zero = F.lit(0)
    spans = "array<struct<head:int,open:int,end:int,closed:boolean>>"
    begin = F.struct(zero.alias("at"), zero.alias("depth"), zero.alias("head"), zero.alias("open"),
                     F.array().cast(spans).alias("spans"))

    def span(state, closed):
        return F.struct(state["head"].alias("head"), state["open"].alias("open"), state["at"].alias("end"),
                        F.lit(closed).alias("closed"))

    def step(state, token):
        depth = state["depth"] + _depth_step(token, "()")
        opens, shuts = (token == "(") & (depth == 1), (token == ")") & (depth == 0)
        return F.struct(
            (state["at"] + 1).alias("at"), depth.alias("depth"),
            F.when(shuts, state["at"] + 1).otherwise(state["head"]).alias("head"),
            F.when(opens, state["at"]).otherwise(state["open"]).alias("open"),
            F.when(shuts, F.array_append(state["spans"], span(state, True))).otherwise(state["spans"]).alias("spans"))

    found = F.aggregate(tokens, begin, step, lambda s: F.when(
        s["depth"] > 0, F.array_append(s["spans"], span(s, False))).otherwise(s["spans"]))
    folded = F.transform(found, lambda p: F.struct(
        _text(tokens, p["head"], p["open"]).alias("head"), _text(tokens, p["open"] + 1, p["end"]).alias("body"),
        p["closed"].alias("closed")))
    # balanced text needs no fold: the pattern yields heads and bodies in pairs
    pair = rf"(?s)((?:[^'\"`()]++|{_QUOTED})*+)\(((?:[^'\"`()]++|{_QUOTED}|{_GROUPS})*+)\)"
    heads, bodies = (F.regexp_extract_all(text, F.lit(pair), F.lit(g)) for g in (1, 2))
    paired = F.zip_with(heads, bodies, lambda h, b: F.struct(
        h.alias("head"), b.alias("body"), F.lit(True).alias("closed")))
    return F.when(text.rlike(_BALANCED), paired).otherwise(folded)


def _first_true(flags: Column, size: Column) -> Column:
    """1-based place of the first true flag, behind the end when there is none."""
    place = F.array_position(flags, F.lit(True)).cast("int")
    return F.when(place > 0, place).otherwise(size + 1)


def cte_bodies(scripts: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """(ids, cte_no, name, body, closed): the chain of ``name AS ( .. )`` behind the first WITH."""
    clean = F.array_join(_tokens(F.col(text), "", rf"--[^\n]*+|{_BLOCK}"), "")
    behind = F.regexp_replace("clean", r"(?is)\A.*?\bwith\b", "")
    name = r"([`\"]?[\w$]+[`\"]?)"
    listing, as_only = rf"(?i)\A\s*{name}\s*\z", r"(?i)\A\s+as\s*\z"

    def start(group, i):
        """Head without its comma; a later head that lacks one starts nothing."""
        return F.when(i == 0, group["head"]).when(
            group["head"].rlike(r"\A\s*,"), F.regexp_replace(group["head"], r"\A\s*,", "")).otherwise("?")

    groups = F.col("groups")

    def mark(group, i):
        before = F.get(groups, i - 1)
        is_list = (start(group, i).rlike(listing) & ~F.contains(group["body"], F.lit("("))
                   & F.coalesce(F.get(groups, i + 1)["head"].rlike(as_only), F.lit(False)))
        plain = F.regexp_extract(start(group, i), rf"(?i)\A\s*{name}\s+as\s*\z", 1)
        listed = F.regexp_extract(start(before, i - 1), listing, 1)
        follows = (i > 0) & group["head"].rlike(as_only) & ~F.contains(before["body"], F.lit("(")) & (listed != "")
        return F.struct((i + 1).cast("bigint").alias("cte_no"),
                        F.when(plain != "", plain).when(follows, listed).alias("name"),
                        group["body"].alias("body"), group["closed"].alias("closed"), is_list.alias("is_list"))

    marks = F.col("marks")
    size = F.size(marks)
    # the chain ends in front of the first group that is neither, and behind one that never closes
    broken = _first_true(F.transform(marks, lambda m: m["name"].isNull() & ~m["is_list"]), size) - 1
    unclosed = _first_true(F.transform(marks, lambda m: ~m["closed"]), size)
    return (
        scripts.withColumn("clean", clean).where(F.col("clean").rlike(r"(?i)\bwith\b"))
        .select(*ids, behind.alias("behind"))
        .select(*ids, "behind", F.when(~F.col("behind").rlike(_BALANCED), _tokens(F.col("behind"), "()")).alias("tokens"))
        .select(*ids, _groups(F.col("behind"), F.col("tokens")).alias("groups"))
        .select(*ids, F.transform("groups", mark).alias("marks"))
        .select(*ids, F.explode_outer(F.slice("marks", F.lit(1), F.least(broken, unclosed, size))).alias("m"))
        .where("m.name is not null")
        .select(*ids, "m.cte_no", _bare_id(F.col("m.name")).alias("name"), "m.body", "m.closed")
    )


def cte_edges(bodies: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, from_table, to_table, to_base): consumer -> referenced CTE or base table, each pair once."""
    refs = (r"(?i)\b(?:from|join)\s+(`[^`]+`(?:\.[`\w]++)*+|[\w$]++(?:\.[\w$]++)*+)(?!\()")
    closed = bodies.where("closed")
    found = (
        closed.select(*ids, "cte_no", F.col("name").alias("from_table"),
                      F.posexplode_outer(F.regexp_extract_all("body", F.lit(refs), F.lit(1))).alias("pos", "ref"))
        .where("ref is not null")
        .withColumn("to_name", F.when(F.startswith("ref", F.lit("`")), _bare_id(F.col("ref")))
                    .otherwise(F.lower(_bare_id(F.col("ref")))))
        .withColumn("to_key", F.lower("to_name"))
    )
    ctes = closed.groupBy(*ids, F.lower("name").alias("to_key")).agg(F.max_by("name", "cte_no").alias("cte"))
    # a base table keeps the spelling it is first met with
    stubs = found.groupBy(*ids, "to_key").agg(F.min_by("to_name", F.struct("cte_no", "pos")).alias("stub"))
    named = found.join(ctes, [*ids, "to_key"], "left").join(stubs, [*ids, "to_key"])
    return (
        named.where(F.col("cte").isNull() | (F.lower("from_table") != F.col("to_key")))
        .select(*ids, "from_table", F.coalesce("cte", "stub").alias("to_table"), F.col("cte").isNull().alias("to_base"))
        .distinct()
    )


def cte_columns(bodies: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, cte_no, cte, col_no, name): alias, else last word, else ``colN``; ``*`` names none."""
    keys = [*ids, "cte_no", "cte"]
    select_list = trim_space(F.regexp_extract("body", r"(?is)\bselect\b(.*?)(?:\bfrom\b|\z)", 1))
    lists = bodies.where("closed").withColumnRenamed("name", "cte").select(*keys, select_list.alias("list"))
    pieces = F.when(F.col("list").rlike(_ANY_BALANCED), F.regexp_extract_all("list", F.lit(_ANY_PIECE), F.lit(0)))
    # the fold is for text the pattern cannot follow; its tokens get a column of their own
    tokens = F.when(F.col("pieces").isNull(), _tokens(F.col("list"), "()[],"))
    parts = F.filter(F.transform(F.coalesce("pieces", _split(F.col("tokens"), ",", "()[]")), trim_space),
                     lambda e: (e != "") & (e != "*"))
    alias = F.regexp_extract("expr", r"(?is)\bas\s+(`[^`]+`|\"[^\"]+\"|[\w$]+)\s*\z", 1)
    word = F.regexp_extract("expr", r"(?s)(`[^`]+`|[\w$]+)\s*\z", 1)
    name = F.when(alias != "", _bare_id(alias)).otherwise(_bare_id(word))
    return (
        lists.where("list <> '*'").select(*keys, "list", pieces.alias("pieces")).select(*keys, "pieces", tokens.alias("tokens"))
        .select(*keys, F.posexplode_outer(parts).alias("pos", "expr")).where("expr is not null")
        .withColumn("col_no", (F.col("pos") + 1).cast("bigint"))
        .select(*keys, "col_no", F.when(name != "", name).otherwise(
            F.concat(F.lit("col"), F.col("col_no").cast("string"))).alias("name")))
