"""Terms, filter expressions and work on query texts."""

import pytest
from pyspark.sql import functions as F

from mergrove import api
from mergrove.errors import BadQuery, ExprSyntaxError, UnboundVariableError
from mergrove.functions import expr, sparql_text, terms
from mergrove.plans.plan import Leaf
from mergrove.sources.tables import TableSource

X = terms.XSD


def typed(value, name):
    return f'"{value}"^^<{X}{name}>'


def evaluate(spark, rows, expression, strict=False):
    """EBV of an expression over rows of N-Triples text, in order."""
    names = sorted({n for r in rows for n in r})
    df = spark.createDataFrame([(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)], ", ".join(["i int", *[f"{n} string" for n in names]])).coalesce(1)
    scope = {n: expr.Value(F.col(n), "nt") for n in names}
    return [r.v for r in df.select("i", expr.condition(expression, scope, strict).alias("v")).orderBy("i").collect()]


def test_effective_boolean_values(spark):
    cases = [
        (None, False), (typed("true", "boolean"), True), (typed("false", "boolean"), False), ('""', False), ("''", False), ('"1"', True), ('"0"', False),
        ('"false"', False), ('"False"', False), ('"true"', True), ('"True"', True), ('"23"', True), ('"-1"', True),
        *[(typed(v, t), b) for t in ("integer", "int") for v, b in (("0", False), ("1", True), ("23", True), ("-1", True))],
        (typed("0.0", "decimal"), False), (typed("23.0", "decimal"), True), (typed("+23.0E-9", "double"), True), ('"+23.0E-9"', True), ('"+0.0E1"', False),
        ("0", False), ("9", True), ("true", True), ("false", False), ('"text"', True), ('" "', True),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = [r.v for r in df.select("i", terms.coerce_to_bool(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [c[1] for c in cases]
    for bad in ('"text"', '" "'):
        with pytest.raises(Exception, match="no boolean value"):
            spark.createDataFrame([(bad,)], "t string").select(terms.coerce_to_bool(F.col("t"), strict=True)).collect()


def test_terms_round_trip(spark):
    texts = ["plain", 'q"uote', "back\\slash", "line\nbreak\r\ttab", "é \U0001f600", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    nt = terms.nt_literal(F.col("t"))
    rows = df.select("t", terms.lexical(nt).alias("back"), nt.alias("nt")).collect()
    assert all(r.t == r.back for r in rows) and {r.nt for r in rows} >= {'"q\\"uote"', '"line\\nbreak\\r\\ttab"'}
    odd = spark.createDataFrame([('"\\u00e9\\U0001F600x"',)], "t string")
    assert odd.select(terms.lexical(F.col("t")).alias("v")).first().v == "é\U0001f600x"
    kinds = {"<a>": "iri", "_:b": "blank", "[]": "blank", '"x"': "literal", '"x"@en': "literal", typed(1, "int"): "literal", "junk": None}
    df = spark.createDataFrame([(k,) for k in kinds], "t string")
    for r in df.select("t", terms.kind(F.col("t")).alias("k"), terms.datatype(F.col("t")).alias("d"), terms.lang(F.col("t")).alias("l")).collect():
        assert r.k == kinds[r.t]
        assert r.d == {'"x"': X + "string", '"x"@en': terms.LANG_STRING, typed(1, "int"): X + "int"}.get(r.t)
        assert r.l == (None if r.k != "literal" else "en" if r.t.endswith("en") else "")


def test_comparisons_of_terms(spark):
    pairs = [(typed(1, "integer"), typed(2, "integer")), (typed(2, "integer"), typed(1, "integer")), (typed(1, "integer"), typed("1.0", "decimal")),
             ('"bob"', '"bob"'), ('"bob"', '"bob"@en'), ('"bob"@en', '"bob"@en'), ("<a>", "<a>"), ("<a>", "<b>"), ('"a"', '"b"'), (None, '"a"'), ('"a"', typed(1, "int"))]
    rows = [{"x": a, "y": b} for a, b in pairs]
    assert evaluate(spark, rows, "?x < ?y") == [True, False, False, False, None, False, None, None, True, None, None]
    assert evaluate(spark, rows, "?x = ?y") == [False, False, True, True, False, True, True, False, False, None, False]
    assert evaluate(spark, rows, "?x != ?y") == [True, True, False, False, True, False, False, True, True, None, True]
    some = [{"x": v} for v in (typed(7, "integer"), typed(27, "integer"), typed("27.4", "decimal"), typed("22.6", "decimal"), '"27"', None)]
    assert evaluate(spark, some, "?x > 23") == [False, True, True, False, None, None]
    assert evaluate(spark, some, "?x > 23 || BOUND(?x)") == [True, True, True, True, True, None]
    assert evaluate(spark, some, '!(?x = "27")') == [True, True, True, True, False, None]


CASES = [
    ("1 + 2 * 3 = 7", True), ("(1 + 2) * 3 = 9", True), ("8 / 4 / 2 = 1", True), ("7 - 2 - 1 = 4", True), ("-(3) < 0", True), ("1 / 2 = 0.5", True), ("1 / 0 = 1", None),
    ("true || 1/0 = 1", True), ("false && 1/0 = 1", False), ("true && 1/0 = 1", None), ("!false", True), ("2 IN (1, 2, 3)", True), ("4 NOT IN (1, 2, 3)", True), ("4 IN ()", False),
    ('"a"@en = "a"@EN', True), ('"a"@en = "a"', False), ('"a" < "b"', True), ("1.5e1 = 15", True), ("true = true", True),
    ('STRLEN("aé\U0001f600") = 3', True), ('SUBSTR("motor", 2, 3) = "oto"', True), ('SUBSTR("motor", 3) = "tor"', True), ('UCASE("aé") = "AÉ"', True), ('LCASE("AÉ") = "aé"', True),
    ('STRSTARTS("abc", "ab")', True), ('STRENDS("abc", "bc")', True), ('CONTAINS("abc", "d")', False), ('STRBEFORE("abc", "b") = "a"', True), ('STRBEFORE("abc", "x") = ""', True),
    ('STRAFTER("abc", "b") = "c"', True), ('CONCAT("a", "b", "c") = "abc"', True), ('ENCODE_FOR_URI("a b/c*é") = "a%20b%2Fc%2A%C3%A9"', True),
    ('REGEX("Hello", "^h", "i")', True), ('REGEX("a.c", "a.c", "q")', True), ('REPLACE("abcb", "b", "X") = "aXcX"', True),
    ("ABS(-2) = 2", True), ("ROUND(2.5) = 3", True), ("ROUND(-2.5) = -2", True), ("CEIL(1.2) = 2", True), ("FLOOR(-1.2) = -2", True), ("RAND() < 1", True),
    ('YEAR("2024-03-05T06:07:08"^^xsd:dateTime) = 2024 && MONTH("2024-03-05T06:07:08"^^xsd:dateTime) = 3 && DAY("2024-03-05T06:07:08"^^xsd:dateTime) = 5', True),
    ('HOURS("2024-03-05T06:07:08"^^xsd:dateTime) = 6 && MINUTES("2024-03-05T06:07:08"^^xsd:dateTime) = 7 && SECONDS("2024-03-05T06:07:08"^^xsd:dateTime) = 8', True),
    ('TZ("2024-03-05T06:07:08Z") = "Z"', True), ("NOW() > \"2000-01-01T00:00:00\"^^xsd:dateTime", True), ('"2024-01-02"^^xsd:date < "2024-01-03"^^xsd:date', True),
    ('MD5("abc") = "900150983cd24fb0d6963f7d28e17f72"', True), ('STRLEN(SHA1("a")) = 40 && STRLEN(SHA256("a")) = 64 && STRLEN(SHA384("a")) = 96 && STRLEN(SHA512("a")) = 128', True),
    ('IF(1 < 2, "a", "b") = "a"', True), ('COALESCE(?none, 1/0, 3) = 3', True), ("BOUND(?none)", False), ("isIRI(<a>) && isURI(<a>) && !isIRI(1)", True), ('isLiteral("a") && !isLiteral(<a>)', True),
    ('isNumeric(1.5) && !isNumeric("1")', True), ("isBlank(BNODE())", True), ('sameTerm(1, 1) && !sameTerm(1, 1.0) && !sameTerm("a", "a"@en)', True),
    ('STR(<http://a>) = "http://a" && STR(12) = "12"', True), ('LANG("a"@fr) = "fr" && LANG("a") = ""', True), ('langMatches(LANG("a"@en-GB), "en") && langMatches("fr", "*")', True),
    ('DATATYPE(1) = xsd:integer && DATATYPE("a") = xsd:string && DATATYPE("a"@en) = rdf:langString', True), ('IRI("http://a") = <http://a>', True),
    ('STRDT("1", xsd:int) = 1', True), ('LANG(STRLANG("a", "de")) = "de"', True), ('xsd:integer("12") = 12 && xsd:double("1e1") = 10', True), ('xsd:boolean("1") && !xsd:boolean("false")', True),
    ('xsd:integer("x") = 1', None), ('xsd:string(5) = "5"', True), ("'single' = \"single\"", True), ('"""long "one" """ = "long \\"one\\" "', True), ("?none = 1", None), ("!(?none = 1)", None),
]


def test_functions(spark):
    one = spark.range(1)
    got = one.select(*[expr.condition(e, {}).alias(f"c{i}") for i, (e, _) in enumerate(CASES)]).first()
    wrong = [(e, want, got[i]) for i, (e, want) in enumerate(CASES) if got[i] is not want and got[i] != want]
    assert not wrong


@pytest.mark.parametrize("bad", ["", "1 +", "(1", "1 2", "nope:x = 1", "FOO(1)", "STRLEN()", 'REGEX("a", "b", "z")', "BOUND(1)", "?x = = 2", "\"open", "1 NOT 2", "$"])
def test_syntax_errors(spark, bad):
    with pytest.raises(ExprSyntaxError):
        expr.condition(bad, {})


def test_errors_drop_rows_unless_strict(spark):
    leaf = Leaf(TableSource(spark.createDataFrame([(1, None), (2, 5)], "a int, b int")))
    with pytest.warns(UserWarning, match="unknown"):
        assert api.run(leaf.filter("?zz = 1 || ?a = 2"), spark).count() == 1
    assert api.run(leaf.filter("?b > 1"), spark).count() == 1
    with pytest.raises(UnboundVariableError):
        api.run(leaf.filter("?zz = 1", strict=True), spark)
    assert api.run(leaf.filter(), spark).count() == 2


def test_own_functions(spark):
    expr.register_function("double", lambda c: c * 2, "num")
    leaf = Leaf(TableSource(spark.createDataFrame([(1,), (2,)], "a int")))
    assert [r.a for r in api.run(leaf.filter("DOUBLE(?a) = 4"), spark).collect()] == [2]


def test_filters_on_typed_literals(spark):
    df = spark.createDataFrame([(f"<s{i}>", typed(i, "integer")) for i in range(1, 10)], "s string, o string")
    leaf = Leaf(TableSource(df, nt=("s", "o")))
    assert [r.s for r in api.run(leaf.filter("?o > 3", "?o < 7"), spark).orderBy("s").collect()] == ["<s4>", "<s5>", "<s6>"]
    assert api.run(leaf.filter("?o != 4", "?o > 0"), spark).count() == 8


# --- query texts


@pytest.mark.parametrize(
    ("text", "public", "every"),
    [
        ("SELECT ?x WHERE {?s ?p ?x}", ["x"], ["x", "s", "p"]),
        ("SELECT * WHERE {?s ?p $o}", ["s", "p", "o"], ["s", "p", "o"]),
        ("ASK {?s <p> ?o}", [], ["s", "o"]),
        ("{?s ?p ?o . FILTER(?o < ?q)}", ["s", "p", "o", "q"], ["s", "p", "o", "q"]),
        ("SELECT (COUNT(?x) AS ?n) ?y {?x <p> ?y}", ["n", "y"], ["x", "n", "y"]),
        ("# ?no\nPREFIX a: <http://x/?no>\nSELECT DISTINCT ?y { ?y a:p '?no', \"?no\", '''?no ' ''' }", ["y"], ["y"]),
    ],
)
def test_variables_of_texts(text, public, every):
    assert sparql_text.public_vars(text) == public and sparql_text.all_vars(text) == every


@pytest.mark.parametrize(
    ("text", "binding", "want"),
    [
        ("ASK {?s :p :o}", {"s": "<a>"}, "ASK {<a> :p :o}"),
        ("SELECT * WHERE {?s ?p ?o}", {"s": "<b>", "o": "<c>"}, "SELECT * WHERE {<b> ?p <c>}"),
        ("SELECT ?s WHERE {?en :p \"?en\"@en; :q ?en.}", {"en": "<a>"}, "SELECT ?s WHERE {<a> :p \"?en\"@en; :q <a>.}"),
        ("SELECT ?s WHERE {?s :p ?o}", {"s": "<a>"}, "ASK {<a> :p ?o}"),
        ("?x < ?y", {"x": "1"}, "1 < ?y"),
        ("?x < ?y", {"y": '"a?x"'}, '?x < "a?x"'),
        ("SELECT * {?s ?p ?o}", {"s": None}, "SELECT * {?s ?p ?o}"),
    ],
)
def test_bind_text(text, binding, want):
    assert sparql_text.bind(text, binding) == want


def test_bind_drops_projected_variables():
    out = sparql_text.bind("SELECT ?en ?s WHERE {?en :r ?s.}", {"en": "<a>"})
    assert out.split() == "SELECT ?s WHERE {<a> :r ?s.}".split() and sparql_text.public_vars(out) == ["s"]


def test_to_ask():
    assert sparql_text.to_ask("SELECT ?x WHERE { <a> <b> ?x }").split() == "ASK { <a> <b> ?x }".split()
    assert sparql_text.to_ask("ASK {?s ?p ?o}") == "ASK {?s ?p ?o}"
    assert sparql_text.to_ask("?s ?p ?o") == "ASK { ?s ?p ?o }"
    assert sparql_text.to_ask("# SELECT ?x\nPREFIX : <#SELECT>\nSELECT * { <a> <b> '''\nASK {}\n''' }") == "# SELECT ?x\nPREFIX : <#SELECT>\nASK { <a> <b> '''\nASK {}\n''' }"
    with pytest.raises(BadQuery):
        sparql_text.to_ask("CONSTRUCT {?s ?p ?o} WHERE {?s ?p ?o}")


def test_variable_sets():
    assert sparql_text.merge_vars("ab", "bc") == ["a", "b", "c"] and sparql_text.common_vars("abc", "cb") == ["b", "c"]
    assert sparql_text.is_product("ab", "cd") and not sparql_text.is_product("ab", "bc")
