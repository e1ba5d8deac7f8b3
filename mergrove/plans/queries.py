"""The registered queries of the algebra over the driver's tables, and their SQL.

Keys of the generated tables are never null (parquet says they might be), so scans declare that; the queries on
unbound values make their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import api
from ..functions import expr, terms
from ..sources.results_files import ResultsFileSource, write_results
from ..sources.shared import shared_folder
from ..sources.tables import TableSource
from ..sources.triples import TriplesSource, triples_of_table
from ..streaming import operators as streaming
from .flags import OperatorFlags
from .lower import lower
from .plan import Leaf, Plan

QUERIES: dict = {}
SQL: dict[str, str] = {}


#: Schemas by path: a table that several leaves scan has its footers read once, not by a job for each leaf.
_SCHEMAS: dict = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def register(sql: str | None = None):
    """Register a function from a scanner to a plan (or DataFrame) under its name, with its SQL."""

    def add(function):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            def scan(table: str, /, *columns: str, hidden: tuple[str, ...] = (), where=None, **renamed: str) -> Plan:
                """A table with ``columns`` under their own names and ``variable=column`` for others."""
                df = _table(spark, sf_dir, table)
                df = df if where is None else df.where(where)
                names = {c: c for c in columns} | {c: v for v, c in renamed.items()}
                return Leaf(TableSource(df, names, hidden, never_null=True, name=table))

            scan.spark, scan.folder, scan.frame = spark, sf_dir, lambda name: _table(spark, sf_dir, name)
            out = function(scan)
            return api.run(out, spark) if isinstance(out, Plan) else out

        query.__name__ = function.__name__
        QUERIES[function.__name__] = query
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _maybe(scan, table: str, columns: dict, key: str, condition, never_null: tuple[str, ...] = ()) -> Plan:
    """A scan in which one column is unbound where a condition fails."""
    df = scan.frame(table).select(*[c for c in columns if c != key], F.when(condition, F.col(key)).alias(key))
    return Leaf(TableSource(df, columns, never_null=never_null, name=table))


# --- scans and projections


@register("SELECT n_name AS name, n_regionkey AS region, CAST(NULL AS VARCHAR) AS nokey FROM nation")
def scan_project(scan):
    return scan("nation", name="n_name", region="n_regionkey").project("name", "region", "nokey")


@register("SELECT n_regionkey AS region, n_name AS name FROM nation")
def project_dup_var(scan):
    return scan("nation", name="n_name", region="n_regionkey").project("region", "name", "region")


@register("SELECT CAST(NULL AS VARCHAR) AS x, CAST(NULL AS VARCHAR) AS y FROM region WHERE false")
def empty_plan(scan):
    return api.empty("x", "y")


# --- filters


@register("SELECT c_custkey AS c, c_nationkey AS n FROM customer WHERE c_nationkey = 7")
def filter_eq(scan):
    return scan("customer", c="c_custkey", n="c_nationkey").filter("?n = 7")


@register("SELECT l_orderkey AS o, l_linenumber AS l, l_quantity AS q FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_shipdate >= TIMESTAMP '1995-01-01'")
def filter_range(scan):
    items = scan("lineitem", o="l_orderkey", l="l_linenumber", q="l_quantity", d="l_shipdate")
    return items.filter("?q >= 10 && ?q < 20", '?d >= "1995-01-01T00:00:00"^^xsd:dateTime').project("o", "l", "q")


@register("SELECT p_partkey AS p, p_size AS s FROM part WHERE p_size > 10 AND (p_size < 20 OR p_size = 50) AND NOT p_size = 15")
def filter_conj(scan):
    return scan("part", p="p_partkey", s="p_size").filter("?s > 10", "?s < 20 || ?s = 50", "!(?s = 15)")


@register("SELECT c_custkey AS c, c_mktsegment AS seg FROM customer WHERE c_mktsegment = 'BUILDING' AND starts_with(c_name, 'Customer') AND length(c_name) > 3 AND contains(lower(c_name), 'customer')")
def filter_string(scan):
    rows = scan("customer", c="c_custkey", name="c_name", seg="c_mktsegment")
    return rows.filter('?seg = "BUILDING"', 'STRSTARTS(?name, "Customer") && STRLEN(?name) > 3', 'CONTAINS(LCASE(?name), "customer")').project("c", "seg")


@register("SELECT o_orderkey AS o, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey NOT IN (1, 2, 3)")
def filter_in(scan):
    return scan("orders", o="o_orderkey", s="o_orderstatus").filter('?s IN ("F", "P")', "?o NOT IN (1, 2, 3)")


@register("SELECT p_partkey AS p, p_type AS t FROM part WHERE regexp_matches(p_type, '(?i)brass|^small')")
def filter_regex(scan):
    return scan("part", p="p_partkey", t="p_type").filter('REGEX(?t, "brass|^small", "i")')


@register("SELECT s_suppkey AS s, s_nationkey AS n FROM supplier WHERE NOT (s_nationkey = 3 OR s_nationkey > 10)")
def filter_not(scan):
    return scan("supplier", s="s_suppkey", n="s_nationkey").filter("!(?n = 3 || ?n > 10)")


@register("SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def filter_bound(scan):
    big = scan("orders", o="o_orderkey", c="o_custkey", where="o_totalprice > 400000")
    return scan("customer", c="c_custkey").left_join(big).filter("!BOUND(?o)")


@register("SELECT c_custkey AS c, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS n FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey < 5 OR c_custkey < 10")
def filter_error_false(scan):
    rows = _maybe(scan, "customer", {"c_custkey": "c", "c_nationkey": "n"}, "c_nationkey", F.expr("c_custkey % 2 = 0"), ("c",))
    return rows.filter("?n < 5 || ?c < 10")


@register("""SELECT o_orderkey AS o FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) IN (1, 2)
  AND o_orderkey / 2.0 + 1 > 10 AND -o_orderkey < 0 AND (CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE 'y' END) = 'y'
  AND md5(o_orderstatus) <> md5('P') AND abs(o_custkey) >= 1 AND replace(o_orderpriority, '-', '') <> '1URGENT'""")
def filter_functions(scan):
    rows = scan("orders", o="o_orderkey", c="o_custkey", d="o_orderdate", s="o_orderstatus", p="o_orderpriority")
    return rows.filter(
        "YEAR(?d) = 1996 && MONTH(?d) IN (1, 2)", "?o / 2 + 1 > 10", "-?o < 0", 'IF(?s = "F", "x", "y") = "y"', 'MD5(?s) != MD5("P")',
        "ABS(?c) >= 1", 'REPLACE(?p, "-", "") != "1URGENT"', 'COALESCE(?nothing, "z") = "z"', "isLiteral(?s) && isNumeric(?o) && !isIRI(?s)",
    ).project("o")


# --- joins


@register("SELECT c_custkey AS c, n_nationkey AS n, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_1(scan):
    return scan("customer", c="c_custkey", n="c_nationkey").join(scan("nation", n="n_nationkey", name="n_name"))


@register("SELECT a.l_orderkey AS o, a.l_linenumber AS l, a.l_quantity AS q, b.l_tax AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def join_multi_key(scan):
    return scan("lineitem", o="l_orderkey", l="l_linenumber", q="l_quantity").join(scan("lineitem", o="l_orderkey", l="l_linenumber", t="l_tax"))


@register("""SELECT c_custkey AS c, o_orderkey AS o, o_totalprice AS price FROM region JOIN nation ON r_regionkey = n_regionkey
  JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey WHERE n_name = (SELECT max(n_name) FROM nation WHERE n_nationkey = 3) AND o_totalprice > 100000""")
def join_nary_reordered(scan):
    plan = api.join(
        scan("region", r="r_regionkey"), scan("orders", o="o_orderkey", c="o_custkey", price="o_totalprice"),
        scan("customer", c="c_custkey", n="c_nationkey"), scan("nation", n="n_nationkey", r="n_regionkey").filter("?n = 3"),
    )
    return plan.filter("?price > 100000").project("c", "o", "price")


@register("SELECT n_nationkey AS n, r_regionkey AS r FROM nation, region")
def join_cartesian(scan):
    return scan("nation", n="n_nationkey").join(scan("region", r="r_regionkey"))


@register("SELECT c_custkey AS c, n_nationkey AS n, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = c_custkey % 5")
def join_hidden_var(scan):
    customers = Leaf(TableSource(scan.frame("customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 5).cast("int").alias("r")), {"c_custkey": "c", "c_nationkey": "n", "r": "r"}, never_null=True))
    nations = scan("nation", n="n_nationkey", r="n_regionkey", name="n_name").project("n", "name")
    return customers.join(nations).project("c", "n", "name")


@register("SELECT o_orderkey AS o FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 300000")
def join_multiplicity(scan):
    return scan("orders", o="o_orderkey", where="o_totalprice > 300000").join(scan("lineitem", o="l_orderkey"))


#: Each order binds two of key, customer and price; any two orders have one of them in common at least.
_TWO_OF = "CASE WHEN {i} % 3 <> 0 THEN o_orderkey END AS k, CASE WHEN {i} % 3 <> 1 THEN o_custkey END AS c, CASE WHEN {i} % 3 <> 2 THEN o_totalprice END AS p"


@register(f"""WITH a AS (SELECT o_orderkey AS x, {_TWO_OF.format(i="o_orderkey")} FROM orders),
  b AS (SELECT o_orderkey AS y, {_TWO_OF.format(i="(o_orderkey // 3)")} FROM orders),
  j AS (SELECT * FROM a JOIN b ON a.k = b.k AND a.c = b.c AND (a.p IS NULL OR b.p IS NULL)
    UNION ALL SELECT * FROM a JOIN b ON a.k = b.k AND a.p = b.p AND (a.c IS NULL OR b.c IS NULL)
    UNION ALL SELECT * FROM a JOIN b ON a.c = b.c AND a.p = b.p AND (a.k IS NULL OR b.k IS NULL)
    UNION ALL SELECT * FROM a JOIN b ON a.k = b.k AND (a.c IS NULL OR b.c IS NULL) AND (a.p IS NULL OR b.p IS NULL)
    UNION ALL SELECT * FROM a JOIN b ON a.c = b.c AND (a.k IS NULL OR b.k IS NULL) AND (a.p IS NULL OR b.p IS NULL)
    UNION ALL SELECT * FROM a JOIN b ON a.p = b.p AND (a.k IS NULL OR b.k IS NULL) AND (a.c IS NULL OR b.c IS NULL))
  SELECT x, y, coalesce(k, k_1) AS k, coalesce(c, c_1) AS c, coalesce(p, p_1) AS p FROM j""")
def join_compat_unbound(scan):
    sides = {}
    for var, i in (("x", "o_orderkey"), ("y", "(o_orderkey div 3)")):
        df = scan.frame("orders").selectExpr(f"o_orderkey AS {var}", *_TWO_OF.format(i=i).split(", "))
        sides[var] = Leaf(TableSource(df, never_null=(var,)))
    return sides["x"].join(sides["y"])


@register("""SELECT c_custkey AS c, o_orderkey AS o, l_linenumber AS l FROM customer
  JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey
  LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON o_orderkey = l_orderkey""")
def left_join_chain(scan):
    big = scan("orders", o="o_orderkey", c="o_custkey", where="o_totalprice > 400000")
    lines = scan("lineitem", o="l_orderkey", l="l_linenumber", where="l_quantity > 45")
    return scan("customer", c="c_custkey").left_join(big).filter("BOUND(?o)").left_join(lines)


@register("SELECT c_custkey AS c, o_orderkey AS o, o_totalprice AS price FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
def left_join(scan):
    return scan("customer", c="c_custkey").left_join(scan("orders", o="o_orderkey", c="o_custkey", price="o_totalprice", where="o_totalprice > 400000"))


@register("SELECT n_nationkey AS n, CAST(NULL AS INTEGER) AS r FROM nation")
def left_join_product_empty(scan):
    return scan("nation", n="n_nationkey").left_join(scan("region", r="r_regionkey", where="r_regionkey < 0"))


@register("SELECT c_custkey AS c, c_acctbal AS bal, o_orderkey AS o, o_totalprice AS price FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 30")
def left_join_filter(scan):
    orders = scan("orders", o="o_orderkey", c="o_custkey", price="o_totalprice").filter("?price > ?bal * 30")
    return scan("customer", c="c_custkey", bal="c_acctbal").left_join(orders)


# --- sets


@register("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def union_same_vars(scan):
    return scan("nation", name="n_name").union(scan("region", name="r_name"))


@register("SELECT n_nationkey AS k, n_name AS nation, CAST(NULL AS VARCHAR) AS region FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def union_diff_vars(scan):
    return scan("nation", k="n_nationkey", nation="n_name").union(scan("region", k="r_regionkey", region="r_name"))


@register("SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey FROM nation")
def union_nary(scan):
    return scan("customer", n="c_nationkey").union(scan("supplier", n="s_nationkey").union(scan("nation", n="n_nationkey")), api.empty("n"), scan("nation", n="n_nationkey"))


@register("""WITH t AS (SELECT l_orderkey AS o, l_linenumber AS l, 1 AS src FROM lineitem WHERE l_quantity > 10
    UNION ALL SELECT l_orderkey, l_linenumber, 2 FROM lineitem WHERE l_quantity < 40),
  r AS (SELECT *, row_number() OVER (PARTITION BY o, l, src) AS k FROM t)
  SELECT o, l FROM (SELECT DISTINCT o, l, k FROM r)""")
def merge_dups(scan):
    return scan("lineitem", o="l_orderkey", l="l_linenumber", where="l_quantity > 10").merge(scan("lineitem", o="l_orderkey", l="l_linenumber", where="l_quantity < 40"))


@register("SELECT DISTINCT l_orderkey AS o, l_linenumber AS l FROM lineitem")
def distinct_rows(scan):
    return scan("lineitem", o="l_orderkey", l="l_linenumber").distinct()


@register("SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS n, c_mktsegment AS seg FROM customer")
def distinct_with_nulls(scan):
    rows = scan.frame("customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("n"), F.col("c_mktsegment").alias("seg"))
    return Leaf(TableSource(rows)).distinct()


@register()
def distinct_window(scan):
    return scan("events", user="user_id", kind="event_type").distinct(16384, flags=OperatorFlags.ALLOW_DUPLICATES)


@register("SELECT DISTINCT user_id AS user, event_type AS kind FROM events")
def distinct_window_then_exact(scan):
    """A window too small for the data loses no row and leaves only duplicates behind."""
    return scan("events", user="user_id", kind="event_type").distinct(64, flags=OperatorFlags.ALLOW_DUPLICATES).distinct()


@register("SELECT DISTINCT event_type AS kind, user_id AS u FROM events")
def events_by_type_distinct_users(scan):
    return scan("events", kind="event_type", u="user_id").distinct()


# --- slices, each over a total order


@register("SELECT o_orderkey AS o, o_totalprice AS price FROM orders ORDER BY price DESC, o LIMIT 25")
def slice_limit(scan):
    return scan("orders", o="o_orderkey", price="o_totalprice").slice(0, 25, ("-price", "o"))


@register("SELECT o_orderkey AS o FROM orders ORDER BY o LIMIT 20 OFFSET 30")
def slice_offset(scan):
    return scan("orders", o="o_orderkey").slice(30, 20, ("o",))


@register("SELECT o_orderkey AS o FROM orders WHERE false")
def slice_zero(scan):
    return scan("orders", o="o_orderkey").slice(0, 0, ("o",))


@register("SELECT n_name AS name FROM nation ORDER BY name LIMIT 100 OFFSET 20")
def slice_past_end(scan):
    return scan("nation", name="n_name").slice(20, 100, ("name",))


@register("""SELECT c_custkey AS c, o_orderkey AS o, o_totalprice AS price FROM customer JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) ON c_custkey = o_custkey WHERE k BETWEEN 2 AND 4""")
def lateral_slice(scan):
    """Of each customer the second to fourth most expensive order: a slice for each left row."""
    orders = scan("orders", o="o_orderkey", c="o_custkey", price="o_totalprice").slice(1, 3, ("-price", "o"))
    return scan("customer", c="c_custkey").lateral_join(orders)


@register("""SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_totalprice > 300000) WHERE k = 2) ON c_custkey = o_custkey""")
def lateral_slice_outer(scan):
    orders = scan("orders", o="o_orderkey", c="o_custkey", where="o_totalprice > 300000").slice(1, 1, ("o",))
    return scan("customer", c="c_custkey").lateral_join(orders, outer=True)


# --- existence


@register("SELECT c_custkey AS c, c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def exists(scan):
    return scan("customer", c="c_custkey", name="c_name").exists(scan("orders", c="o_custkey", where="o_totalprice > 400000"))


@register("SELECT c_custkey AS c, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def not_exists(scan):
    return scan("customer", c="c_custkey", name="c_name").not_exists(scan("orders", c="o_custkey", where="o_totalprice > 400000"))


@register("SELECT n_nationkey AS n FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey > 2)")
def exists_disjoint(scan):
    return scan("nation", n="n_nationkey").exists(scan("region", r="r_regionkey", where="r_regionkey > 2"))


@register("SELECT n_nationkey AS n FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000)")
def exists_ask(scan):
    ask = scan("customer", n="c_nationkey", bal="c_acctbal").filter("?bal > 9000").project()
    return scan("nation", n="n_nationkey").exists(ask)


@register("SELECT c_custkey AS c, c_acctbal AS bal FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50)")
def exists_correlated_filter(scan):
    return scan("customer", c="c_custkey", bal="c_acctbal").exists(scan("orders", c="o_custkey", price="o_totalprice").filter("?price > ?bal * 50"))


@register("SELECT n_nationkey AS n, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def minus(scan):
    return scan("nation", n="n_nationkey", name="n_name").minus(scan("supplier", n="s_nationkey", where="s_acctbal > 8000"))


@register("SELECT n_nationkey AS n FROM nation")
def minus_disjoint(scan):
    return scan("nation", n="n_nationkey").minus(scan("region", r="r_regionkey"))


@register("""WITH a AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS n FROM customer),
  b AS (SELECT CASE WHEN s_acctbal > 8500 THEN s_nationkey END AS n FROM supplier)
  SELECT c, n FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.n = b.n)""")
def minus_unbound(scan):
    a = _maybe(scan, "customer", {"c_custkey": "c", "c_nationkey": "n"}, "c_nationkey", F.expr("c_custkey % 3 <> 0"), ("c",))
    rich = scan.frame("supplier").select(F.when(F.expr("s_acctbal > 8500"), F.col("s_nationkey")).alias("n"))
    return a.minus(Leaf(TableSource(rich)))


@register("SELECT c_custkey AS c FROM customer WHERE c_nationkey = 5 AND c_mktsegment = 'BUILDING'")
def bind_constant(scan):
    return scan("customer", c="c_custkey", n="c_nationkey", seg="c_mktsegment").filter('?seg = "BUILDING"').project("c").bind({"n": 5})


# --- triples


def _orders_as_triples(scan, orders=None) -> DataFrame:
    orders = scan.frame("orders") if orders is None else orders
    customers = scan.frame("customer")
    return (
        triples_of_table(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "orders", "o_orderkey", links={"o_custkey": "customer"})
        .union(triples_of_table(customers.select("c_custkey", "c_name", "c_nationkey"), "customer", "c_custkey", links={"c_nationkey": "nation"}))
        .union(triples_of_table(scan.frame("nation").select("n_nationkey", "n_name"), "nation", "n_nationkey"))
    )


_P = {"": "http://example.org/"}
_IRI = "'<http://example.org/{0}/' || {1} || '>'"
_O, _C, _N = (_IRI.format(t, k) for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("nation", "n_nationkey")))


@register(f"SELECT {_O} AS o, '\"' || o_orderstatus || '\"' AS st, '<http://example.org/customer/' || o_custkey || '>' AS c FROM orders WHERE o_orderstatus = 'F'")
def bgp_star(scan):
    return api.triples(_orders_as_triples(scan), 'SELECT ?o ?st ?c WHERE { ?o :o_orderstatus ?st; :o_custkey ?c . FILTER(?st = "F") }', _P)


@register(f"SELECT {_O} AS o, '\"' || n_name || '\"' AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def bgp_path(scan):
    return api.triples(_orders_as_triples(scan), "SELECT ?o ?name WHERE { ?o :o_custkey ?c . ?c :c_nationkey ?n . ?n :n_name ?name }", _P)


@register(f"SELECT {_C} AS c, CASE WHEN o_orderkey IS NOT NULL THEN {_O} END AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
def bgp_optional(scan):
    data = _orders_as_triples(scan, scan.frame("orders").where("o_totalprice > 400000"))
    return api.triples(data, "SELECT ?c ?o WHERE { ?c :c_name ?name OPTIONAL { ?o :o_custkey ?c } }", _P)


@register(f"SELECT {_C} AS c FROM customer WHERE c_custkey % 7 = 0 AND c_nationkey <> 4 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def bgp_filter(scan):
    customers = Leaf(TriplesSource(_orders_as_triples(scan), "SELECT ?c WHERE { ?c :c_custkey ?k; :c_nationkey ?n . FILTER(?k / 7 = FLOOR(?k / 7)) FILTER(?n != <http://example.org/nation/4>) FILTER EXISTS { ?o :o_custkey ?c; :o_orderstatus \"P\" } }", _P))
    return customers


# --- terms


@register("""SELECT n_nationkey AS n, '"' || n_name || '"' AS plain, '"' || n_nationkey || '"^^<http://www.w3.org/2001/XMLSchema#int>' AS typed,
  '"' || n_name || '"@en-US' AS tagged, '<http://example.org/' || n_nationkey || '>' AS iri, n_name AS name, n_nationkey AS back,
  'http://www.w3.org/2001/XMLSchema#int' AS datatype, 'en-US' AS lang FROM nation""")
def terms_roundtrip(scan):
    df = scan.frame("nation")
    typed = df.select(
        F.col("n_nationkey").alias("n"), terms.nt_literal(F.col("n_name")).alias("plain"), terms.to_nt(F.col("n_nationkey"), df.schema["n_nationkey"].dataType).alias("typed"),
        terms.nt_literal(F.col("n_name"), lang="en_US").alias("tagged"), terms.nt_iri(F.concat(F.lit("http://example.org/"), F.col("n_nationkey").cast("string"))).alias("iri"),
    )
    return typed.select("*", terms.lexical(F.col("plain")).alias("name"), terms.to_native(F.col("typed"), "int").alias("back"), terms.datatype(F.col("typed")).alias("datatype"), terms.lang(F.col("tagged")).alias("lang"))


@register("SELECT p_partkey AS p, p_size % 3 <> 0 AS num, p_size % 2 = 0 AS truth, false AS nothing, length(p_name) > 0 AS text FROM part")
def ebv_table(scan):
    df = scan.frame("part")
    typed = lambda c, t: terms.nt_literal(c.cast("string"), terms.XSD + t)
    return df.select(
        F.col("p_partkey").alias("p"), terms.coerce_to_bool(typed(F.col("p_size") % 3, "integer")).alias("num"),
        terms.coerce_to_bool(typed(F.col("p_size") % 2 == 0, "boolean")).alias("truth"), terms.coerce_to_bool(F.lit('""')).alias("nothing"),
        terms.coerce_to_bool(terms.nt_literal(F.col("p_name"))).alias("text"),
    )


# --- functions of filters, each as a column


def _computed(plan: Plan, spark: SparkSession, keep: tuple[str, ...], **expressions: str) -> DataFrame:
    """``keep`` and the values of expressions over a plan's solutions: whole numbers as longs, others as doubles."""
    s = lower(plan, spark)
    scope = {v: s.value(v) for v in s.columns}
    out = [s.col(v).alias(v) for v in keep]
    for name, text in expressions.items():
        v = expr.compile_expr(text, scope)
        out.append((v.column.cast("long" if v.type in terms.INTEGERS else "double") if v.domain == "num" else v.column).alias(name))
    return s.df.select(*out)


@register("""SELECT p_partkey AS p, length(p_name) AS n, substr(p_name, 3) AS tail, substr(p_name, 2, 4) AS mid, upper(p_name) AS up, lower(p_type) AS low,
  starts_with(p_type, 'S') AS starts, ends_with(p_type, 'L') AS ends, contains(p_name, 'a') AS has,
  CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, 1, instr(p_name, ' ') - 1) ELSE '' END AS before,
  CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END AS after,
  p_brand || '-' || p_size AS both, replace(p_name, ' ', '%20') AS uri, regexp_replace(p_name, '[aeiou]+', '_', 'g') AS swapped,
  regexp_matches(p_name, '(?i)^[a-m].*\\d') AS found FROM part""")
def functions_string(scan):
    rows = scan("part", p="p_partkey", name="p_name", type="p_type", brand="p_brand", size="p_size")
    return _computed(
        rows, scan.spark, ("p",), n="STRLEN(?name)", tail="SUBSTR(?name, 3)", mid="SUBSTR(?name, 2, 4)", up="UCASE(?name)", low="LCASE(?type)",
        starts='STRSTARTS(?type, "S")', ends='STRENDS(?type, "L")', has='CONTAINS(?name, "a")', before='STRBEFORE(?name, " ")', after='STRAFTER(?name, " ")',
        both='CONCAT(?brand, "-", STR(?size))', uri='REPLACE(ENCODE_FOR_URI(?name), "%23", "#")', swapped='REPLACE(?name, "[aeiou]+", "_")', found='REGEX(?name, "^[a-m].*[0-9]", "i")',
    )


@register("""SELECT c_custkey AS c, abs(c_acctbal) AS a, CAST(floor(c_acctbal + 0.5) AS DOUBLE) AS r, CAST(ceil(c_acctbal) AS DOUBLE) AS up, CAST(floor(c_acctbal) AS DOUBLE) AS down,
  c_acctbal + c_nationkey AS plus, c_acctbal - 2 AS less, -c_acctbal AS neg, c_acctbal * 3 AS times, c_acctbal / 4 AS part,
  CASE WHEN c_nationkey <> 0 THEN c_acctbal / c_nationkey END AS div FROM customer""")
def functions_numeric(scan):
    rows = scan("customer", c="c_custkey", bal="c_acctbal", n="c_nationkey")
    return _computed(
        rows, scan.spark, ("c",), a="ABS(?bal)", r="ROUND(?bal)", up="CEIL(?bal)", down="FLOOR(?bal)", plus="?bal + ?n", less="?bal - 2", neg="-?bal", times="?bal * 3", part="?bal / 4", div="?bal / ?n",
    )


@register("""SELECT event_id AS e, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, CAST(floor(second(ts)) AS BIGINT) AS s,
  CASE event_id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+05:30' WHEN 2 THEN '-08:00' ELSE '' END AS zone,
  CASE event_id % 4 WHEN 0 THEN 'PT0S' WHEN 1 THEN 'PT5H30M' WHEN 2 THEN '-PT8H' END AS away FROM events""")
def functions_time(scan):
    stamp = F.concat(F.lit("2020-02-29T01:02:03"), F.expr("CASE event_id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+05:30' WHEN 2 THEN '-08:00' ELSE '' END"))
    rows = scan.frame("events").select("event_id", "ts", stamp.alias("stamp"))
    plan = Leaf(TableSource(rows, {"event_id": "e", "ts": "t", "stamp": "z"}, never_null=True))
    return _computed(plan, scan.spark, ("e",), y="YEAR(?t)", m="MONTH(?t)", d="DAY(?t)", h="HOURS(?t)", mi="MINUTES(?t)", s="SECONDS(?t)", zone="TZ(?z)", away="STR(TIMEZONE(?z))")


@register("SELECT s_suppkey AS s, md5(s_name) AS m, sha1(s_name) AS s1, sha256(s_name) AS s2, 128 AS n5, 96 AS n3 FROM supplier")
def functions_hash(scan):
    rows = scan("supplier", s="s_suppkey", name="s_name")
    return _computed(rows, scan.spark, ("s",), m="MD5(?name)", s1="SHA1(?name)", s2="SHA256(?name)", n5="STRLEN(SHA512(?name))", n3="STRLEN(SHA384(?name))")


_KIND = "CASE n_nationkey % 5 WHEN 0 THEN '<http://example.org/' || n_name || '>' WHEN 1 THEN '_:b' || n_nationkey WHEN 2 THEN '\"' || n_name || '\"@en-GB' WHEN 3 THEN '\"' || n_nationkey || '\"^^<http://www.w3.org/2001/XMLSchema#integer>' ELSE '\"' || n_name || '\"' END"


@register(f"""WITH t AS (SELECT n_nationkey AS n, n_name, n_nationkey % 5 AS k, {_KIND} AS x FROM nation)
  SELECT n, k = 0 AS iri, k = 1 AS blank, k > 1 AS literal, k = 3 AS number, CASE k WHEN 0 THEN 'http://example.org/' || n_name WHEN 1 THEN NULL WHEN 3 THEN CAST(n AS VARCHAR) ELSE n_name END AS text,
    CASE WHEN k < 2 THEN NULL WHEN k = 2 THEN 'en-GB' ELSE '' END AS lang, CASE k WHEN 2 THEN 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' WHEN 3 THEN 'http://www.w3.org/2001/XMLSchema#integer' WHEN 4 THEN 'http://www.w3.org/2001/XMLSchema#string' END AS type,
    CASE WHEN k >= 2 THEN k = 2 END AS english, true AS same FROM t""")
def functions_terms(scan):
    rows = scan.frame("nation").selectExpr("n_nationkey AS n", f"{_KIND} AS x")
    plan = Leaf(TableSource(rows, {"n": "n", "x": "x"}, nt=("x",), never_null=True))
    return _computed(
        plan, scan.spark, ("n",), iri="isIRI(?x)", blank="isBLANK(?x)", literal="isLITERAL(?x)", number="isNUMERIC(?x)", text="STR(?x)", lang="LANG(?x)", type="STR(DATATYPE(?x))",
        english='LANGMATCHES(LANG(?x), "EN")', same="sameTerm(?x, ?x)",
    )


@register("""SELECT c_custkey AS c, n = 3 AND b AS a, n = 3 OR b AS o, NOT (n = 3) AS no, n IN (1, 2, 3) AS among, n NOT IN (1, 2, 3) AS outside, n <= 12 AS most,
  CASE WHEN n IS NOT NULL THEN CASE WHEN n < 12 THEN 'low' ELSE 'high' END END AS side, coalesce(n, -1) AS filled, n IS NOT NULL AS bound
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS n, c_custkey % 2 = 0 AS b FROM customer)""")
def functions_logic(scan):
    rows = scan.frame("customer").selectExpr("c_custkey AS c", "CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS n", "c_custkey % 2 = 0 AS b")
    plan = Leaf(TableSource(rows, never_null=("c", "b")))
    return _computed(
        plan, scan.spark, ("c",), a="?n = 3 && ?b", o="?n = 3 || ?b", no="!(?n = 3)", among="?n IN (1, 2, 3)", outside="?n NOT IN (1, 2, 3)", most="?n <= 12",
        side='IF(?n < 12, "low", "high")', filled="COALESCE(?n, -1)", bound="BOUND(?n)",
    ).withColumn("filled", F.col("filled").cast("long"))


@register("""SELECT o_orderkey AS o, CAST(o_orderkey AS DOUBLE) AS whole, CAST(floor(o_totalprice) AS DOUBLE) AS small, o_totalprice AS real, o_orderkey % 2 = 1 AS truth, o_orderkey > 0 AS number,
  CAST(o_orderkey AS VARCHAR) AS text, CAST(NULL AS DOUBLE) AS wrong, year(o_orderdate) AS y FROM orders""")
def functions_casts(scan):
    df = scan.frame("orders").selectExpr(
        "o_orderkey AS o", "CAST(o_orderkey AS STRING) AS k", "CAST(floor(o_totalprice) AS STRING) AS f", "CAST(o_totalprice AS STRING) AS p",
        "CASE o_orderkey % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'true' WHEN 2 THEN '0' ELSE '1' END AS b", "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") AS d", "o_orderstatus AS s")
    plan = Leaf(TableSource(df, never_null=True))
    out = _computed(
        plan, scan.spark, ("o",), whole="xsd:double(?k)", small="xsd:integer(?f)", real="xsd:double(?p)", truth="xsd:boolean(?b)", number="xsd:boolean(?o)", text="xsd:string(?o)",
        wrong="xsd:double(?s)", y="YEAR(xsd:dateTime(?d))",
    )
    return out.withColumn("small", F.col("small").cast("double"))


# --- results files: written, and read back as a source


def _file(scan, label: str) -> str:
    return f"{shared_folder(scan.spark)}/mergrove/{label}-{uuid.uuid4().hex}"


_ROUND = """SELECT '"' || n_name || '"' AS name, '"' || n_nationkey || '"^^<http://www.w3.org/2001/XMLSchema#int>' AS k, CASE WHEN n_regionkey <> 2 THEN '<http://example.org/' || n_regionkey || '>' END AS r FROM nation"""


def _round_terms(scan) -> DataFrame:
    return scan.frame("nation").select(
        terms.nt_literal(F.col("n_name")).alias("name"), terms.to_nt(F.col("n_nationkey"), T.IntegerType()).alias("k"),
        F.when(F.col("n_regionkey") != 2, terms.nt_iri(F.concat(F.lit("http://example.org/"), F.col("n_regionkey").cast("string")))).alias("r"))


@register(_ROUND)
def results_tsv(scan):
    path = _file(scan, "results")
    write_results(_round_terms(scan), path, ("name", "k", "r"))
    return api.query(ResultsFileSource(scan.spark, path, "tsv"))


@register(_ROUND)
def results_json(scan):
    def cell(name: str, kind: str, value, datatype=None):
        parts = [F.lit(kind).alias("type"), value.alias("value"), *([F.lit(datatype).alias("datatype")] if datatype else [])]
        return F.when(value.isNotNull(), F.struct(*parts)).alias(name)

    region = F.when(F.col("n_regionkey") != 2, F.concat(F.lit("http://example.org/"), F.col("n_regionkey").cast("string")))
    row = F.struct(cell("name", "literal", F.col("n_name")), cell("k", "literal", F.col("n_nationkey").cast("string"), terms.XSD + "int"), cell("r", "uri", region))
    body = scan.frame("nation").agg(F.to_json(F.struct(F.struct(F.array(*map(F.lit, ("name", "k", "r"))).alias("vars")).alias("head"), F.struct(F.collect_list(row).alias("bindings")).alias("results"))).alias("value"))
    path = _file(scan, "results")
    body.coalesce(1).write.text(path)
    return api.query(ResultsFileSource(scan.spark, path, "json"))


@register("""SELECT '"' || n_name || '"' AS name, '"' || n_nationkey || '"' AS k, CASE WHEN n_regionkey <> 2 THEN '<http://example.org/' || n_regionkey || '>' END AS r FROM nation""")
def results_csv(scan):
    region = F.when(F.col("n_regionkey") != 2, F.concat(F.lit("http://example.org/"), F.col("n_regionkey").cast("string"))).otherwise("")
    path = _file(scan, "results")
    scan.frame("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("k"), region.alias("r")).coalesce(1).write.csv(path, header=True, emptyValue="")
    return api.query(ResultsFileSource(scan.spark, path, "csv"))


# --- streams: all that is there is processed as a stream into files, which are the result


def _streamed(scan, sf_dir: str, table: str) -> DataFrame:
    return scan.spark.readStream.schema(scan.frame(table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _drained(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """What a stream has made of its input so far."""
    job = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@register("SELECT event_id AS e, value AS v, c_name AS name FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase' AND value > 10")
def stream_filter_join(scan):
    """A stream of events filtered and joined with a table."""
    events = Leaf(TableSource(_streamed(scan, scan.folder, "events"), {"event_id": "e", "user_id": "c", "event_type": "kind", "value": "v"}, never_null=True))
    plan = events.filter('?kind = "purchase"', "?v > 10").join(scan("customer", c="c_custkey", name="c_name")).project("e", "v", "name")
    return _drained(scan.spark, streaming.run(plan, scan.spark), _file(scan, "stream"))


@register("SELECT event_id AS e FROM events WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal > 5000) UNION ALL SELECT event_id FROM events WHERE value < 5")
def stream_exists_union(scan):
    events = lambda **names: Leaf(TableSource(_streamed(scan, scan.folder, "events"), names, never_null=True))
    rich = events(event_id="e", user_id="c").exists(scan("customer", c="c_custkey", where="c_acctbal > 5000")).project("e")
    cheap = events(event_id="e", value="v").filter("?v < 5").project("e")
    return _drained(scan.spark, streaming.run(rich.union(cheap), scan.spark), _file(scan, "stream"))


@register("SELECT DISTINCT user_id AS user, event_type AS kind FROM events")
def stream_distinct_within(scan):
    """Distinct over a stream, within a span that covers all of it."""
    events = _streamed(scan, scan.folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("user"), F.col("event_type").alias("kind"))
    return _drained(scan.spark, streaming.distinct_within(events, "ts", "3650 days").select("user", "kind"), _file(scan, "stream"))
