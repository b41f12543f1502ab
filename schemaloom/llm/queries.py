"""Registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from . import exact_dedup, fill_middle, language, licenses, mixing, ngram_join, packing, pii, token_files, toxicity, turn_repair, url_rules, vector_dedup

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op5_exact_dedup", r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)""")
def op5_exact_dedup(spark, folder):
    return exact_dedup.groups_of(table(spark, folder, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


# Fixed values of the contract: (host, path, verdict).
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@query("op6_url_filter", r"""
WITH r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                                       ('org', '/fr/', 'allow')),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
m AS (SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
             arg_max(verdict, length(r.host || r.path)) AS verdict
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""")
def op6_url_filter(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, folder, "pages"), rules)


@query("op7_source_mix", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
g AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM s),
w AS (SELECT *, [3.0, 1.0, 2.0][((no - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM g),
l AS (SELECT *, ((SELECT 1.5::DOUBLE * sum(source_size) FROM s)
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
b AS (SELECT max(level) AS best FROM l WHERE level <= cap / weight),
t AS (SELECT source, source_size, least(cap, coalesce(best * weight, cap)) AS target,
             ('0x' || substr(md5('mix-1/' || coalesce(source, chr(0))), 1, 4))::BIGINT / 65536.0::DOUBLE AS shift FROM l, b),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.shift,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS step,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(d.doc_id::VARCHAR) NULLS LAST, d.doc_id NULLS LAST) AS place
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(step * place + shift) - floor(step * (place - 1) + shift))::BIGINT * size AS taken FROM k""")
def op7_source_mix(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op9_pack_documents")
def op9_pack_documents(spark, folder):
    # plain documents bear no limit on pieces: a sequence never holds more pieces than tokens
    pieces = packing.pack(table(spark, folder, "documents"), segments=packing.SEQUENCE)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op10_token_files")
def op10_token_files(spark, folder):
    target = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_images(table(spark, folder, "documents"), target)
    return token_files.read_documents(spark, target)


@query("op4_ngram_join")
def op4_ngram_join(spark, folder):
    return ngram_join.groups(table(spark, folder, "documents"))


@query("op1_embedding_dedup")
def op1_embedding_dedup(spark, folder):
    return vector_dedup.near_dedup(table(spark, folder, "embeddings"))


@query("op3_language_id")
def op3_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    out = language.held_out(folds=5, fold=0)
    model = language.learn(docs.where(~out))
    return language.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op2_toxicity")
def op2_toxicity(spark, folder):
    docs, out = table(spark, folder, "documents"), toxicity.held_out(folds=4, fold=2)
    model = toxicity.learn(docs.where(~out), table(spark, folder, "labels").where(~out))
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


@query("op8_license_scan")
def op8_license_scan(spark, folder):
    """Documents as files ``source/language/id``; a text of at most 40 words counts as its folder's licence file."""
    docs = table(spark, folder, "documents").withColumn(
        "path", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("und")), F.col("doc_id").cast("string")))
    short = mixing.words_in(F.col("text")) <= 40
    return licenses.scan(docs, "doc_id", "path", "text", short, licenses.default_templates(spark))


@query("op11_fill_middle", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
             ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
      FROM t),
c AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS x, array_to_string(units[a + 1:b], '') AS y,
             array_to_string(units[b + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(y) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
                        WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p""")
def op11_fill_middle(spark, folder):
    made = fill_middle.transform(table(spark, folder, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def _pii_sql() -> str:
    """The same patterns, validators and words in SQL; spans come from the pieces between a pattern's matches."""
    digits = r"regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (f"list_sum([CASE WHEN i % 2 = 1 THEN d WHEN d < 5 THEN 2 * d ELSE 2 * d - 9 END FOR d, i IN "
            f"list_transform(string_split(reverse({digits}), ''), lambda x: x::BIGINT)])")
    shapes = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+){3}", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 "
                                         "OR ('0' || right(ltrim(p, '0'), 3))::BIGINT > 255)) = 0"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 13 AND 19 AND {luhn} % 10 = 0"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
        "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", "true"),
        "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "m[1:3] NOT IN ('000', '666') AND m[1:3] < '900' AND m[5:6] <> '00' AND m[8:11] <> '0000'"),
        "tel": (r"\b[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}\b", "true")}

    def account(form):
        bare = f"replace({form}, ' ', '')"
        value = "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ord(c) - 48 ELSE ord(c) - 55 END::BIGINT"
        return (f"(length({bare}) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split({bare}[5:] || {bare}[1:4], ''), {value}), "
                "lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, 0::BIGINT) = 1)")

    short = "regexp_replace(m, ' [A-Z0-9]{1,3}$', '')"
    parts, near = [], []
    for no, rule in enumerate(pii.RULES):
        shape, _ = shapes[rule.kind]
        parts.append(f"SELECT rid, {no} AS no, '{rule.kind}' AS kind, text, regexp_extract_all(text, '{shape}') AS ms, "
                     f"string_split_regex(text, '{shape}') AS gaps FROM t")
        near.append(f"WHEN {no} THEN {rule.score}::DOUBLE + {rule.moves} * (regexp_matches(around, '\\b(?:{rule.near})\\b', 'i')::INT "
                    f"- regexp_matches(around, '\\b(?:{rule.against})\\b', 'i')::INT)")
    holds = " ".join(f"WHEN {no} THEN {shapes[r.kind][1]}" for no, r in enumerate(pii.RULES))
    iban = [r.kind for r in pii.RULES].index("iban")
    told = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY no, a)"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p AS ({" UNION ALL ".join(parts)}),
u AS (SELECT rid, no, kind, text, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM p),
s AS (SELECT rid, no, kind, text, m, (sum(length(g) + length(m)) OVER (PARTITION BY rid, no ORDER BY i))::BIGINT - length(m) AS a FROM u),
v AS (SELECT rid, no, kind, text, a, a + CASE WHEN no <> {iban} THEN length(m) WHEN {account("m")} THEN length(m)
             WHEN {account(short)} THEN length({short}) ELSE 0 END AS b FROM s WHERE CASE no {holds} END),
w AS (SELECT *, no < {len(pii.BASE)} AS base, substr(text, greatest(a - {pii.BEFORE}, 0) + 1, least(a, {pii.BEFORE})) || chr(10)
             || substr(text, b + 1, {pii.AFTER}) AS around FROM v WHERE b > a),
x AS (SELECT * FROM w WHERE base OR (CASE no {" ".join(near)} END >= {pii.STAYS} AND NOT EXISTS (
        SELECT 1 FROM w o WHERE o.base AND o.rid = w.rid AND o.a <= w.a AND w.b <= o.b))),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (WHERE no = {no}) AS n_{k}" for no, k in enumerate(pii.BASE))},
             {told} FILTER (WHERE base) AS own, {told} AS spans FROM x GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(own, '')) AS base_sha256,
       coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (rid)"""


@query("op13_pii", _pii_sql())
def op13_pii(spark, folder):
    found = pii.find(table(spark, folder, "documents"))
    counts = [F.size(F.filter("spans", pii.of_kind(k))).cast("bigint").alias(f"n_{k}") for k in pii.BASE]
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *counts, F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def _repair_sql() -> str:
    """The cheapest edits row by row from the front: per state the least (cost, audit, text so far)."""
    def edit(state, letter, cost, line=None):
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t" + (f" || chr(10) || {line}" if line else "") + "}"

    def least(*ways):
        return f"list_sort([{', '.join(ways)}])[1]"

    def only(test, way):
        return f"CASE WHEN {test} THEN {way} ELSE {{'c': 1000000000::BIGINT, 'a': '', 't': ''}} END"

    def filled(source):
        return (f"SELECT *, {least('a', edit('u1', 'I', 3, repr('assistant:')))} AS a1 FROM "
                f"(SELECT *, {least('u', *[edit(x, 'I', 3, repr('user:')) for x in 'nsa'])} AS u1 FROM {source})")

    keep, as_user, as_assistant = "role || ':' || text", "'user:' || text", "'assistant:' || text"

    def kept(state, initial):
        return only(f"live AND kind = '{initial}'", edit(state, "K", "more", keep))

    def turned(state, line):
        return only("live", edit(state, "R", "more + 3", line))

    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
        lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, 4294967295::BIGINT),
    4294967295::BIGINT) % 20 AS way FROM conversations),
d AS (SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role,
             CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE way WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE way <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS no, role[1:1] AS kind FROM d),
g AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY no) > 1 THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
             lag(kind) OVER (PARTITION BY conv_id ORDER BY no) || kind AS pair FROM o),
f AS (SELECT *, fault IN ('', 'truncated') AS live, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM g),
x AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
             count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
             count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
      FROM f GROUP BY conv_id),
w AS (SELECT conv_id, 0::BIGINT AS no, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS n, {only("false", "n")} AS s, {only("false", "n")} AS u,
             {only("false", "n")} AS a FROM x
  UNION ALL
  SELECT conv_id, no, {edit("n", "D", 4)}, {least(edit("s", "D", 4), kept("n", "s"))},
         {least(edit("u1", "D", 4), *[kept(x, "u") for x in ("n", "s", "a1")], *[turned(x, as_user) for x in ("n", "s", "a1")])},
         {least(edit("a1", "D", 4), kept("u1", "a"), turned("u1", as_assistant))}
  FROM ({filled("(SELECT f.conv_id, f.no, n, s, u, a, role, text, kind, live, more FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.no = w.no + 1)")})),
e AS (SELECT z.conv_id, {least("n", "a1")} AS best FROM ({filled("w")}) z JOIN x ON x.conv_id IS NOT DISTINCT FROM z.conv_id
      WHERE z.no = x.rows)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(best.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query("op12_turn_repair", _repair_sql())
def op12_turn_repair(spark, folder):
    fixed = turn_repair.audit(table(spark, folder, "conversations"))
    return fixed.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
