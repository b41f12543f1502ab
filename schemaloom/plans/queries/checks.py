"""Constraint checks on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import checks as c
from ...operators.checks import Contract, Link
from ..live import found_links
from ..registry import query

# Contracts of the given tables: name -> (not-null columns, key, foreign keys).
CONTRACTS = (
    Contract("lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"),
             (("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey")), ("l_orderkey", "l_linenumber"),
             ((("l_orderkey",), "orders", ("o_orderkey",)), (("l_partkey",), "part", ("p_partkey",)),
              (("l_suppkey",), "supplier", ("s_suppkey",)))),
    Contract("orders", ("o_orderkey", "o_custkey", "o_orderdate"), (("o_custkey", "o_orderdate"),), ("o_orderkey",),
             ((("o_custkey",), "customer", ("c_custkey",), "c_acctbal > 0"),)),
    Contract("customer", ("c_custkey", "c_name", "c_acctbal"), (("c_name",),), ("c_custkey",),
             ((("c_nationkey",), "nation", ("n_nationkey",)),)),
    Contract("documents", ("doc_id", "text", "lang"), (("text",),), ("doc_id",)),
)


def datasets(t):
    return {name: getattr(t, name) for name in (
        "lineitem", "orders", "customer", "part", "supplier", "nation", "documents")} | {
        "good_customer": t.customer.where("c_acctbal > 0")}


def contract_sql(contracts=CONTRACTS) -> str:
    """The same checks written out one by one."""
    out = []
    for k in contracts:
        head = f"SELECT '{k.table}' AS table_name, '%s' AS check_name, '%s' AS columns, "
        for col in k.not_null:
            out.append(head % ("not_null", col) + "count(*) FILTER (WHERE %s IS NULL) AS violations, "
                       "count(*) FILTER (WHERE %s IS NULL) AS failed_rows FROM {%s}" % (col, col, k.table))
        for cols in k.unique:
            some = " AND ".join(f"{col} IS NOT NULL" for col in cols)
            out.append(head % ("unique", ",".join(cols)) + "count(*) AS violations, "
                       "CAST(coalesce(sum(n), 0) AS BIGINT) AS failed_rows FROM (SELECT count(*) AS n FROM {%s} "
                       "WHERE %s GROUP BY %s HAVING count(*) > 1)" % (k.table, some, ", ".join(cols)))
        if k.primary_key:
            null = " OR ".join(f"{col} IS NULL" for col in k.primary_key)
            out.append(head % ("primary_key", ",".join(k.primary_key)) + "count(*) AS violations, "
                       "CAST(coalesce(sum(n), 0) AS BIGINT) AS failed_rows FROM (SELECT count(*) AS n FROM {%s} "
                       "GROUP BY %s HAVING count(*) > 1 OR %s)" % (k.table, ", ".join(k.primary_key), null))
        for cols, parent, pcols, *where in k.foreign_keys:
            match = " AND ".join(f"p.{b} = c.{a}" for a, b in zip(cols, pcols, strict=True))
            source = "(SELECT * FROM {%s} WHERE %s)" % (parent, where[0]) if where else "{%s}" % parent
            out.append(head % ("relationship", ",".join(cols))
                       + "count(DISTINCT %s) AS violations, count(*) AS failed_rows FROM {%s} c WHERE %s AND "
                         "NOT EXISTS (SELECT 1 FROM %s p WHERE %s)" % (
                             cols[0], k.table, " AND ".join(f"c.{a} IS NOT NULL" for a in cols), source, match))
    return "\nUNION ALL\n".join(out)


@query("run_contract", contract_sql())
def run_contract(t):
    return c.run_contracts(CONTRACTS, datasets(t))


@query("check_not_null", """
SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} o
LEFT JOIN (SELECT c_custkey, c_name FROM {customer} WHERE c_acctbal > 0) c ON c_custkey = o_custkey
WHERE c_name IS NULL""")
def check_not_null(t):
    named = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = t.orders.join(named, "o_custkey", "left")
    return c.check_not_null(rows, "c_name").select("o_orderkey", "o_custkey", "o_totalprice")


@query("check_not_null_columns", """
SELECT 'c_name' AS column_name, count(*) FILTER (WHERE c_name IS NULL) AS violations FROM (
  SELECT c_name FROM {orders} LEFT JOIN (SELECT * FROM {customer} WHERE c_acctbal > 0) c ON c_custkey = o_custkey)
UNION ALL SELECT 'o_custkey', count(*) FILTER (WHERE o_custkey IS NULL) FROM {orders}
UNION ALL SELECT 'o_orderdate', count(*) FILTER (WHERE o_orderdate IS NULL) FROM {orders}""")
def check_not_null_columns(t):
    named = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return c.not_null_counts(t.orders.join(named, "o_custkey", "left"), ["c_name", "o_custkey", "o_orderdate"])


@query("check_unique", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem}
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def check_unique(t):
    return c.check_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("check_unique_text", """
SELECT md5(text) AS text_md5, count(*) AS n FROM {documents} WHERE text IS NOT NULL
GROUP BY text HAVING count(*) > 1""")
def check_unique_text(t):
    return c.check_unique(t.documents, ["text"]).select(F.md5("text").alias("text_md5"), "n")


NULLED = "SELECT event_type, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS user_key FROM {events}"


@query("check_primary_key", f"""
SELECT event_type, user_key, count(*) AS n, user_key IS NULL OR event_type IS NULL AS has_null,
       count(*) > 1 AND user_key IS NOT NULL AND event_type IS NOT NULL AS duplicated
FROM ({NULLED}) GROUP BY event_type, user_key
HAVING count(*) > 1 OR user_key IS NULL OR event_type IS NULL""")
def check_primary_key(t):
    return c.check_primary_key(t.derive(NULLED), ["event_type", "user_key"])


@query("check_relationship", """
SELECT o_custkey, count(*) AS n FROM {orders}
WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 0) GROUP BY o_custkey""")
def check_relationship(t):
    return c.check_relationship(t.orders, ["o_custkey"], t.customer.where("c_acctbal > 0"), ["c_custkey"])


@query("check_relationship_composite", """
SELECT l_partkey, l_suppkey, count(*) AS n FROM {lineitem} l
WHERE NOT EXISTS (SELECT 1 FROM {lineitem} p WHERE p.l_partkey = l.l_partkey AND p.l_suppkey = l.l_suppkey
                  AND p.l_returnflag = 'N' AND p.l_quantity > 10)
GROUP BY l_partkey, l_suppkey""")
def check_relationship_composite(t):
    parent = t.lineitem.where("l_returnflag = 'N' AND l_quantity > 10")
    return c.check_relationship(t.lineitem, ["l_partkey", "l_suppkey"], parent, ["l_partkey", "l_suppkey"])


@query("relation_cardinality", """
SELECT count(*) AS parents, count(*) FILTER (WHERE n = 0) AS childless, min(n) AS min_children,
       round(avg(n), 6) AS avg_children, max(n) AS max_children
FROM (SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey)""")
def relation_cardinality(t):
    return c.relation_cardinality(t.orders, ["o_custkey"], t.customer, ["c_custkey"])


LINKS = (
    Link("orders", "o_custkey", "good_customer", "c_custkey"),
    Link("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    Link("events", "user_id", "supplier", "s_suppkey"),
    Link("labels", "doc_id", "documents", "doc_id"),
    Link("part", "p_size", "nation", "n_nationkey"),
)


def _link_sql(link: Link) -> str:
    parent = ("(SELECT * FROM {customer} WHERE c_acctbal > 0)" if link.parent == "good_customer"
              else "{%s}" % link.parent)
    return ("SELECT '%s.%s' AS child, '%s.%s' AS parent, count(*) AS child_values, count(k) AS found, "
            "round(count(k) / count(*), 6) AS share FROM (SELECT DISTINCT %s AS v FROM {%s}) LEFT JOIN "
            "(SELECT DISTINCT %s AS k FROM %s) ON v = k WHERE v IS NOT NULL" % (
                link.child, link.child_col, link.parent, link.parent_col, link.child_col, link.child,
                link.parent_col, parent))


@query("verify_links", "\nUNION ALL\n".join(_link_sql(x) for x in LINKS))
def verify_links(t):
    return c.verify_inferred_links(LINKS, datasets(t) | {"events": t.events, "labels": t.labels})


# The given tables under names without their prefix, as a schema of one naming style has them.
PREFIXED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
KEYS = {"region": "regionkey", "nation": "nationkey", "customer": "custkey", "supplier": "suppkey", "part": "partkey", "orders": "orderkey",
        "documents": "doc_id", "pages": "page_id"}
FOUND = (("nation", "regionkey", "region"), ("customer", "nationkey", "nation"), ("supplier", "nationkey", "nation"),
         ("orders", "custkey", "customer"), ("lineitem", "orderkey", "orders"), ("lineitem", "partkey", "part"),
         ("lineitem", "suppkey", "supplier"), ("labels", "doc_id", "documents"))


def _found_sql(child: str, col: str, parent: str) -> str:
    own = col if child not in PREFIXED else f"{child[0]}_{col}"
    other = col if parent not in PREFIXED else f"{parent[0]}_{col}"
    where = " WHERE c_acctbal > 0" if parent == "customer" else ""
    return (f"SELECT '{child}' AS from_key, '{col}' AS from_col, '{parent}' AS to_key, '{col}' AS to_col, count(*) AS child_values, "
            f"count(k) AS found, round(count(k) / count(*), 6) AS share FROM (SELECT DISTINCT {own} AS v FROM {{{child}}}"
            f"{' WHERE c_acctbal > 0' if child == 'customer' else ''}) LEFT JOIN "
            f"(SELECT DISTINCT {other} AS k FROM {{{parent}}}{where}) ON v = k WHERE v IS NOT NULL")


@query("verify_found_links", "\nUNION ALL\n".join(_found_sql(*x) for x in FOUND))
def verify_found_links(t):
    """Links inferred from the column names of the given tables and checked on their rows, in one plan."""
    tables = {name: getattr(t, name) for name in (*PREFIXED, "documents", "labels", "pages")}
    tables["customer"] = t.customer.where("c_acctbal > 0")
    for name in PREFIXED:
        tables[name] = tables[name].toDF(*[c.split("_", 1)[1] for c in tables[name].columns])
    return found_links(tables, KEYS).drop("project", "rule", "ord")


ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
LINES = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
         "l_linestatus", "l_shipdate")
PROFILE = "SELECT *, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS status_or_null FROM {orders}"


def profile_sql(source: str, cols, more: str = "") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {more}'{col}' AS column_name, count({col}) AS filled, count(*) - count({col}) AS nulls, "
        f"count(DISTINCT {col}) AS distinct_values FROM {source}" for col in cols)


@query("column_profile", profile_sql(f"({PROFILE})", (*ORDERS, "status_or_null")))
def column_profile(t):
    return c.column_profile(t.derive(PROFILE))


@query("column_profile_lines", profile_sql("{lineitem}", LINES))
def column_profile_lines(t):
    return c.column_profile(t.lineitem)
