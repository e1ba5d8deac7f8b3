"""Sources: triples, results documents, endpoints, configuration and the WebSocket protocol."""

import http.server
import json
import threading
import urllib.parse
from collections import Counter

import pytest

from mergrove import api
from mergrove.errors import ExprSyntaxError, IllegalArgument, MalformedResults, ServerError, UnacceptableConfiguration, WrongQueryType
from mergrove.functions import terms
from mergrove.plans.plan import Leaf
from mergrove.sources import results_text
from mergrove.sources.config import Configuration, Endpoint, MediaType, escape_query_param
from mergrove.sources.endpoint import EndpointSource, bind_join, bind_union, fetch, graph_text, register, request, values_query
from mergrove.sources.results_files import ResultsFileSource, write_results
from mergrove.sources.triples import TriplesSource, read_turtle, triples_of_table
from mergrove.sources.web_socket import Conversation

P = "http://example.org/"
I = terms.XSD + "integer"  # noqa: E741


def num(n):
    return f'"{n}"^^<{I}>'


def iri(n):
    return f"<{P}{n}>"


GRAPH = """
@prefix : <http://example.org/> .
:a1 :price 1 . :a2 :price 2, 3 . :a3 :price 5 .
:b1 :cost 1 ; a :Shop . :b2 :cost 3 . :b3 :cost 3 ; :name "Bob"@en, "Bob" .
:n1 :next :n2 . :n2 :next :n3, :n4 . :n3 :next :n5 . :n4 :next :n5 .
:n5 :text "a\\n\\"b\\"" ; :half 0.5 ; :ok true ; :none [] . :a1 :price 1 .
"""


@pytest.fixture(scope="module")
def graph(spark):
    df = read_turtle(spark, GRAPH).coalesce(1)
    df.createOrReplaceTempView("graph")
    return df.cache()


def solve(spark, graph, text):
    plan = api.triples(graph, text, {"": P})
    df = api.run(plan, spark)
    return df.columns, Counter(tuple(r) for r in df.collect())


def test_turtle_is_a_set(graph):
    rows = [tuple(r) for r in graph.collect()]
    assert len(rows) == len(set(rows)) == 19
    assert (iri("b1"), f"<{terms.RDF}type>", iri("Shop")) in rows and (iri("n5"), iri("half"), f'"0.5"^^<{terms.XSD}decimal>') in rows
    assert (iri("n5"), iri("text"), '"a\\n\\"b\\""') in rows


@pytest.mark.parametrize(
    ("text", "columns", "rows"),
    [
        ("SELECT ?p { :a2 :price ?p }", ["p"], [(num(2),), (num(3),)]),
        ("SELECT * WHERE { ?s :price ?p . ?t :cost ?p }", ["s", "p", "t"], [(iri("a1"), num(1), iri("b1")), (iri("a2"), num(3), iri("b2")), (iri("a2"), num(3), iri("b3"))]),
        ("SELECT ?x { ?x a :Shop }", ["x"], [(iri("b1"),)]),
        ("SELECT ?a ?c { ?a :next ?b . ?b :next ?c . }", ["a", "c"], [(iri("n1"), iri("n3")), (iri("n1"), iri("n4")), (iri("n2"), iri("n5")), (iri("n2"), iri("n5"))]),
        ("SELECT DISTINCT ?a ?c { ?a :next ?b . ?b :next ?c }", ["a", "c"], [(iri("n1"), iri("n3")), (iri("n1"), iri("n4")), (iri("n2"), iri("n5"))]),
        ("SELECT ?s ?n { ?s :cost ?c OPTIONAL { ?s :name ?n } FILTER(?c > 2) }", ["s", "n"], [(iri("b2"), None), (iri("b3"), '"Bob"@en'), (iri("b3"), '"Bob"')]),
        ('SELECT ?s { ?s :name "Bob" }', ["s"], [(iri("b3"),)]),
        ("SELECT ?s { { ?s :cost 1 } UNION { ?s :price 1 } }", ["s"], [(iri("b1"),), (iri("a1"),)]),
        ("SELECT ?s { ?s :cost ?c MINUS { ?s :name ?n } }", ["s"], [(iri("b1"),), (iri("b2"),)]),
        ("SELECT ?s { ?s :cost ?c FILTER NOT EXISTS { ?s :name ?n } }", ["s"], [(iri("b1"),), (iri("b2"),)]),
        ("SELECT ?s { ?s :cost ?c FILTER EXISTS { ?s :name ?n . FILTER(LANG(?n) = \"en\") } }", ["s"], [(iri("b3"),)]),
        ("PREFIX e: <http://example.org/> SELECT ?p { e:a1 e:price ?p ; e:price ?p }", ["p"], [(num(1),)]),
        ("ASK { :a1 :price 1 }", [], [()]),
        ("ASK { :a1 :price 7 }", [], []),
        ("SELECT ?s { ?s :ok true ; :half 0.5 }", ["s"], [(iri("n5"),)]),
        ("?s :cost 1 . ?s a ?k", ["s", "k"], [(iri("b1"), iri("Shop"))]),
        ("SELECT ?s { ?s :price ?p } LIMIT 0", ["s"], []),
    ],
)
def test_queries_over_triples(spark, graph, text, columns, rows):
    assert solve(spark, graph, text) == (columns, Counter(rows))


@pytest.mark.parametrize("bad", ["SELECT ?x { ?x :p }", "SELECT ?x { ?x nope:p 1 }", "SELECT ?x { ?x :p 1 ", "SELECT (1 AS ?x) { ?x :p 1 }", "ASK { ?x :p 1 } extra"])
def test_bad_queries(graph, bad):
    with pytest.raises(ExprSyntaxError):
        TriplesSource(graph, bad, {"": P})
    with pytest.raises(WrongQueryType):
        TriplesSource(graph, "DESCRIBE <a>")


def test_unselected_variables_join(spark, graph):
    left = api.triples(graph, "SELECT ?o ?s { ?s :price ?o }", {"": P})
    ask = api.triples(graph, "ASK { ?t :cost ?o }", {"": P})
    one = api.triples(graph, "SELECT ?t { ?t :cost ?o }", {"": P})
    assert {r.o for r in api.run(left.exists(ask), spark).collect()} == {num(1), num(3)}
    assert Counter(tuple(r) for r in api.run(left.join(one), spark).collect()) == Counter([(num(1), iri("a1"), iri("b1")), (num(3), iri("a2"), iri("b2")), (num(3), iri("a2"), iri("b3"))])
    assert {r.o for r in api.run(left.minus(one), spark).collect()} == {num(2), num(5)}
    swapped = api.join(ask, left)
    assert {r.o for r in api.run(swapped, spark).collect()} == {num(1), num(3)}
    bound = left.join(one).bind({"o": num(3)})
    assert Counter(tuple(r) for r in api.run(bound, spark).collect()) == Counter([(iri("a2"), iri("b2")), (iri("a2"), iri("b3"))])


def test_tables_as_triples(spark):
    df = spark.createDataFrame([(1, "x", 7), (2, None, 7)], "k int, name string, other long")
    rows = {tuple(r) for r in triples_of_table(df, "t", "k", links={"other": "u"}).collect()}
    one = api.triples(triples_of_table(df, "t", "k"), "SELECT ?s ?o { ?s :name ?o }", {"": P})
    plan = api.run(one, spark)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Generate" not in plan
    assert (iri("t/1"), iri("name"), '"x"') in rows and (iri("t/2"), iri("other"), iri("u/7")) in rows and len(rows) == 5


# --- results documents

JSON_CELLS = [
    ({"value": "23", "type": "literal", "datatype": I}, num(23)), ({"value": "23", "type": "literal"}, '"23"'), ({"value": 'a"b', "type": "literal"}, '"a\\"b"'),
    ({"value": "bob", "type": "literal", "xml:lang": "en_US"}, '"bob"@en-US'), ({"value": "1", "type": "literal", "datatype": "xsd:int"}, f'"1"^^<{terms.XSD}int>'),
    ({"value": "1", "type": "literal", "datatype": f"<{I}>"}, num(1)), ({"value": "bob", "xml:lang": "en"}, '"bob"@en'), ({"value": "bob"}, '"bob"'),
    ({"value": "http://a/b"}, "<http://a/b>"), ({"value": "b0", "type": "bnode"}, "_:b0"), ({"value": "_:b1", "type": "bnode"}, "_:b1"), ({"value": "_:b2"}, "_:b2"),
    ({"value": "Alice", "type": "uri"}, "<Alice>"), ({"value": "23", "type": "iri", "datatype": I}, "<23>"), ({"value": "b", "type": "blank", "xml:lang": "en"}, "_:b"),
]


def test_json_cells():
    for cell, want in JSON_CELLS:
        assert results_text.json_term(cell) == want
    assert results_text.json_term({"type": "bnode"}).startswith("_:") and len(results_text.json_term({"type": "bnode", "value": ""})) > 10
    with pytest.raises(MalformedResults):
        results_text.json_term({"type": "odd", "value": "x"})


def read(kind, text):
    names, rows = results_text.parse(kind, text)
    return names, list(rows)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[]", ([], [])), ("{}", ([], [])), ('{"head":{"vars":[]}}', ([], [])), ('{"head":{"vars":["x"]},"results":{"bindings":null}}', (["x"], [])),
        ('{"head":{"vars":["x","y"]},"results":{"bindings":[{"x":{"value":"1","type":"literal"}},]}}', (["x", "y"], [('"1"', None)])),
        ('{"head":{},"boolean":true}', ([], [()])), ('{"boolean":"False"}', ([], [])), ('{"boolean":1}', ([], [()])),
    ],
)
def test_json_documents(text, want):
    assert read("application/sparql-results+json; charset=utf-8", text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", ([], [])), ("\n", ([], [])), ("\n\n", ([], [()])), ("?x\n", (["x"], [])), ("?x\n\n", (["x"], [(None,)])), ("?x\n<a>", (["x"], [("<a>",)])),
        ("x\t$y\n\t<b>\n", (["x", "y"], [(None, "<b>")])), ("?x\n23\n+1.5\n-1e3\ntrue\n", (["x"], [(num(23),), (f'"+1.5"^^<{terms.XSD}decimal>',), (f'"-1e3"^^<{terms.XSD}double>',), (f'"true"^^<{terms.XSD}boolean>',)])),
        ('?x\n"a"@en_US\n\'b\'\n"c"^^xsd:int\nfree text\n_:b\n', (["x"], [('"a"@en-US',), ('"b"',), (f'"c"^^<{terms.XSD}int>',), ('"free text"',), ("_:b",)])),
        ("?x\t?y\n\"\\ta\"\t\"\\nb\"\n", (["x", "y"], [('"\\ta"', '"\\nb"')])), ("?_askResult\ntrue\n", ([], [()])), ("_askResult\nfalse\n", ([], [])),
    ],
)
def test_tsv_documents(text, want):
    assert read("text/tab-separated-values", text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", ([], [])), ("\r\n", ([], [])), ("\r\n\r\n", ([], [()])), ("x,y\r\n", (["x", "y"], [])), ('" x ","y"\r\n', (["x", "y"], [])), ('",","y"\r\n', ([",", "y"], [])),
        ("x\r\n23\r\n", (["x"], [('"23"',)])), ("x,y\r\n_:b,http://a\r\n", (["x", "y"], [("_:b", "<http://a>")])),
        ('x,y\r\n"a,""b""",HTTP://A\r\n"1\r\n2",\r\n', (["x", "y"], [('"a,\\"b\\""', "<HTTP://A>"), ('"1\\r\\n2"', None)])),
        ('_askResult\r\n"true"', ([], [()])), ("_askResult\r\nfalse\r\n", ([], [])), ("_askResult\r\n", ([], [])),
    ],
)
def test_csv_documents(text, want):
    assert read("text/csv", text) == want


@pytest.mark.parametrize(
    ("kind", "text"),
    [("text/csv", "x\r\n1,2\r\n"), ("text/csv", 'x\r\n"an ""a"."\r\n'), ("text/csv", 'x\r\n"open\r\n'), ("text/tsv", "?x\n<a>\t<b>\n"), ("text/tsv", "?x\t?y\n<a>\n"),
     ("application/json", "{"), ("application/json", '{"x":false}'), ("text/plain", "x"), ("application/json", '{"boolean":"maybe"}')],
)
def test_malformed_documents(kind, text):
    with pytest.raises(MalformedResults):
        read(kind, text)


def test_results_files(spark, tmp_path):
    cells = {"head": {"vars": ["i", "x"]}, "results": {"bindings": [{"i": {"type": "literal", "value": str(i)}, "x": c} for i, (c, _) in enumerate(JSON_CELLS)]}}
    (tmp_path / "r.json").write_text(json.dumps(cells))
    got = {r.i: r.x for r in api.run(Leaf(ResultsFileSource(spark, str(tmp_path / "r.json"))), spark).collect()}
    assert got == {f'"{i}"': want for i, (_, want) in enumerate(JSON_CELLS)}
    (tmp_path / "a.json").write_text('{"head":{},"boolean":true}')
    assert api.ask(Leaf(ResultsFileSource(spark, str(tmp_path / "a.json"))), spark)
    tsv = "?x\t?y\n<a>\t23\n\t\"q\"@en_US\n'no term\t1.5\n"
    (tmp_path / "r.tsv").write_text(tsv)
    got = Counter(tuple(r) for r in api.run(Leaf(ResultsFileSource(spark, str(tmp_path / "r.tsv"))), spark).collect())
    assert got == Counter([("<a>", num(23)), (None, '"q"@en-US'), ('"\'no term"', f'"1.5"^^<{terms.XSD}decimal>')])
    (tmp_path / "r.csv").write_bytes(b'x,y\r\n"a,""b""",http://e/\r\n"1\r\n2",\r\n')
    got = Counter(tuple(r) for r in api.run(Leaf(ResultsFileSource(spark, str(tmp_path / "r.csv"))), spark).collect())
    # Spark's reader makes line ends within quotes one character
    assert got == Counter([('"a,\\"b\\""', "<http://e/>"), ('"1\\n2"', None)])
    (tmp_path / "bad.tsv").write_text("?x\n<a>\t<b>\n")
    with pytest.raises(Exception, match="columns instead of 1"):
        api.run(Leaf(ResultsFileSource(spark, str(tmp_path / "bad.tsv"))), spark).collect()
    assert api.run(Leaf(ResultsFileSource(spark, str(tmp_path / "bad.tsv"), mode="PERMISSIVE")), spark).count() == 1
    with pytest.raises(IllegalArgument):
        ResultsFileSource(spark, "x.xml")
    df = spark.createDataFrame([(1, "<a>", "s\t"), (None, None, "t")], "n int, i string, s string")
    write_results(df.coalesce(1), str(tmp_path / "out"), nt=("i",))
    back = ResultsFileSource(spark, str(tmp_path / "out"), "tsv")
    got = Counter(tuple(r) for r in api.run(Leaf(back), spark).collect())
    assert got == Counter([(f'"1"^^<{terms.XSD}int>', "<a>", '"s\\t"'), (None, None, '"t"')])


# --- configuration


def test_addresses():
    e = Endpoint.parse("json,tsv,get,post@http://h/sparql?a=b")
    assert (e.uri, e.config.results, e.config.methods) == ("http://h/sparql?a=b", ("json", "tsv"), ("get", "post"))
    assert Endpoint.parse("ttl@https://h").config.graphs == ("ttl",) and Endpoint.parse("ws://h/x").config.methods == ("ws",)
    for bad in ("ftp://h", "nope@http://h", "get@ws://h"):
        with pytest.raises(IllegalArgument):
            Endpoint.parse(bad)


def test_overlay():
    own = Configuration(("get", "post"), ("tsv", "json"), params={"a": ("1",)}, headers={"X": "1"})
    both = own.overlay(Configuration(("post",), ("json", "tsv"), params={"a": ("2",)}, headers={"x": "2"}, append_headers={"y": ("3",)}))
    assert both.methods == ("post",) and both.results == ("json", "tsv") and both.params["a"] == ("1", "2") and both.headers == {"x": "2"}
    assert own.accepts(Configuration(("get",))) and not own.accepts(Configuration(("form",)))
    with pytest.raises(UnacceptableConfiguration):
        own.overlay(Configuration(results=("csv",)))
    with pytest.raises(UnacceptableConfiguration):
        Configuration(results=("xml",)).supported()
    with pytest.raises(IllegalArgument):
        Configuration(methods=("put",))
    assert own.method_for("x" * 2000) == "post" and Configuration(("get",)).method_for("x") == "get"
    assert Configuration(results=("tsv", "json")).accept_header() == "text/tab-separated-values, application/sparql-results+json; q=0.9"


def test_media_types():
    m = MediaType.parse('Text/CSV; Charset="utf-16" ;header=present')
    assert (m.type, m.subtype, m.charset) == ("text", "csv", "utf-16")
    assert MediaType.parse("text/*").accepts(m) and MediaType.parse("*/*").accepts(m) and not MediaType.parse("text/tsv").accepts(m)
    assert not MediaType.parse("text/csv;charset=utf-8").accepts(m) and str(MediaType.parse("a/b;c=d")) == "a/b;c=d"
    with pytest.raises(IllegalArgument):
        MediaType.parse("text")
    assert escape_query_param("a b&c=d#é") == "a%20b%26c%3Dd%23%C3%A9"


# --- endpoints


class Handler(http.server.BaseHTTPRequestHandler):
    """Answers VALUES queries over a fixed relation, and oddities by path."""

    data = [("<s1>", '"a"'), ("<s1>", '"b"'), ("<s2>", '"c"')]
    asked: list = []
    flaky = 0

    def log_message(self, *_):
        pass

    def do_POST(self):
        body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
        self.answer(urllib.parse.parse_qs(body)["query"][0] if "form" in self.headers["Content-Type"] else body)

    def do_GET(self):
        self.answer(urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).get("query", [""])[0])

    def answer(self, query):
        cls = type(self)
        cls.asked.append((self.command, self.path, dict(self.headers), query))
        status, kind, text = 200, "text/tab-separated-values; charset=utf-8", "?s\t?o\n" + "".join("\t".join(r) + "\n" for r in self.data)
        if "VALUES" in query:
            import re

            names = re.findall(r"\?(\w+)", query[query.index("VALUES") : query.index(")", query.index("VALUES"))])
            wanted = re.findall(r"\?(\w+)", query[: query.index("WHERE")])
            cells = re.findall(r"\(([^()?]*)\)", query[query.index("VALUES") : query.index("}")])
            out = []
            for c in cells:
                for s, o in self.data:
                    row = dict(zip(names, c.split()))
                    full = {"s": s, "o": o}
                    if all(row[n] in ("UNDEF", full[n]) for n in names if n in full):
                        out.append("\t".join(full.get(v, row.get(v, "")) for v in wanted))
            text = "\t".join("?" + v for v in wanted) + "\n" + "".join(x + "\n" for x in dict.fromkeys(out))
        elif query.startswith("ASK"):
            kind, text = "application/sparql-results+json", '{"boolean": true}'
        elif query.startswith("CONSTRUCT"):
            kind, text = "text/turtle", "<a> <b> <c> ."
        if self.path.startswith("/flaky") and cls.flaky > 0:
            cls.flaky -= 1
            status = 503
        status = {"/bad": 400, "/moved": 302}.get(self.path.split("?")[0], status)
        self.send_response(status)
        if status == 302:
            self.send_header("Location", "/")
        if not self.path.startswith("/untyped"):
            self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(text.encode())))
        self.end_headers()
        self.wfile.write(text.encode())


@pytest.fixture(scope="module")
def server():
    httpd = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}"
    httpd.shutdown()


def test_endpoint_reads_and_joins(spark, server):
    leaf = Leaf(EndpointSource(f"tsv,get@{server}/sparql", "SELECT ?s ?o WHERE {?s <p> ?o}"))
    assert Counter(tuple(r) for r in api.run(leaf, spark).collect()) == Counter(Handler.data)
    local = spark.createDataFrame([("<s2>", 5)], "s string, n int")
    from mergrove.sources.tables import TableSource

    assert [tuple(r) for r in api.run(Leaf(TableSource(local, nt=("s",))).join(leaf), spark).collect()] == [("<s2>", 5, '"c"')]
    assert api.ask(Leaf(EndpointSource(f"json@{server}/x", "ASK {?s <p> ?o}")), spark)
    register(spark)
    graph = spark.read.format("sparql").options(uri=f"{server}/x", query="CONSTRUCT {?s ?p ?o} WHERE {?s ?p ?o}", mode="graph").load()
    assert graph_text(graph).first().text == "<a> <b> <c> ."
    got = graph.collect()
    assert [(r.chunk, r.media_type, bytes(r.fragment)) for r in got] == [(0, "text/turtle", b"<a> <b> <c> .")]
    with pytest.raises(WrongQueryType):
        EndpointSource(server, "DESCRIBE <a>")


def test_requests(server):
    Handler.asked.clear()
    for method in ("get", "post", "form"):
        kind, body = fetch(Endpoint.parse(f"tsv,{method}@{server}/q?k=v"), "SELECT * {?s ?p ?o}")
        assert kind.subtype == "tab-separated-values" and body.startswith(b"?s")
    assert [a[0] for a in Handler.asked] == ["GET", "POST", "POST"] and all(a[3] == "SELECT * {?s ?p ?o}" for a in Handler.asked)
    assert all(a[2].get("Accept", a[2].get("accept")) == "text/tab-separated-values" for a in Handler.asked)
    e = Endpoint(server, Configuration(("get",), params={"t": ("1 2",)}, headers={"X-A": "b"}, append_headers={"X-A": ("c",)}))
    r = request(e, "ASK {}")
    assert "t=1%202" in r.full_url and r.get_header("X-a") == "b, c"


def test_endpoint_errors(server):
    for path, error in (("/bad", ServerError), ("/moved", ServerError), ("/untyped", MalformedResults)):
        with pytest.raises(error):
            fetch(Endpoint.parse(server + path), "SELECT * {}")
    Handler.flaky = 2
    assert fetch(Endpoint.parse(server + "/flaky"), "SELECT * {}", wait=0.01)[1].startswith(b"?s")
    Handler.flaky = 9
    with pytest.raises(ServerError):
        fetch(Endpoint.parse(server + "/flaky"), "SELECT * {}", retries=1, wait=0.01)
    with pytest.raises(ServerError):
        fetch(Endpoint.parse("http://127.0.0.1:9/"), "SELECT * {}", retries=1, wait=0.01)


def test_bound_queries(spark, server):
    left = spark.createDataFrame([("<s1>", "<x>"), ("<s3>", "<y>"), (None, "<z>")], "s string, k string").coalesce(1)
    query = "SELECT ?s ?o WHERE {?s <p> ?o}"
    run = lambda kind, **o: Counter(tuple(r) for r in bind_join(left, f"post,tsv@{server}/b", query, kind, **o).collect())
    every = [("<s1>", "<x>", '"a"'), ("<s1>", "<x>", '"b"'), ("<s1>", "<z>", '"a"'), ("<s1>", "<z>", '"b"'), ("<s2>", "<z>", '"c"')]
    assert run("join") == Counter(every) and run("join", batch_rows=1) == Counter(every)
    assert run("left_join") == Counter([*every, ("<s3>", "<y>", None)])
    assert run("exists") == Counter([("<s1>", "<x>"), (None, "<z>")]) and run("not_exists") == Counter([("<s3>", "<y>")])
    assert run("minus") == Counter([("<s3>", "<y>"), (None, "<z>")])
    shared = bind_join(left, f"post,tsv@{server}/b", "SELECT ?s WHERE {?s <p> ?o}", "join")
    assert Counter(tuple(r) for r in shared.where("k = '<x>'").collect()).total() >= 1
    assert bind_join(left, server, "SELECT ?q WHERE {?q <p> ?r}", "minus") is left
    text, wanted = values_query("PREFIX : <x> SELECT ?o WHERE {?s :p ?o} LIMIT 5", ["s"], [["<a>"], [None]])
    assert text == "PREFIX : <x> SELECT ?s ?o WHERE { VALUES (?s) { (<a>) (UNDEF) } {?s :p ?o} } LIMIT 5" and wanted == ["s", "o"]


def test_bound_unions(spark, server):
    """A right side of several queries: each batch of left rows goes to all of them."""
    left = spark.createDataFrame([("<s1>", "<x>"), ("<s3>", "<y>")], "s string, k string").coalesce(1)
    query, uri = "SELECT ?s ?o WHERE {?s <p> ?o}", f"post,tsv@{server}/b"
    run = lambda n, kind, **o: Counter(tuple(r) for r in bind_union(left, [(uri, query)] * n, kind, **o).collect())
    once = [("<s1>", "<x>", '"a"'), ("<s1>", "<x>", '"b"')]
    for n in (1, 2, 3, 16):
        assert run(n, "join") == Counter(once * n) and run(n, "join", merge=True, batch_rows=1) == Counter(once)
        assert run(n, "left_join") == Counter([*once * n, ("<s3>", "<y>", None)])
        assert run(n, "exists") == Counter([("<s1>", "<x>")]) and run(n, "not_exists") == run(n, "minus") == Counter([("<s3>", "<y>")])
    other = [(uri, query), (uri, "SELECT ?q WHERE {?q <p> ?r}")]
    assert bind_union(left, other, "minus").count() == 1 and bind_union(left, other[1:], "minus") is left
    assert bind_union(left, other, "join").columns == ["s", "k", "o", "q"]


class Slow:
    """A stream that gives a few characters at a time, and tells how far it has been read."""

    def __init__(self, text, size):
        self.text, self.size, self.given = text, size, 0

    def read(self, _=None):
        piece = self.text[self.given : self.given + self.size]
        self.given += len(piece)
        return piece


@pytest.mark.parametrize("size", [1, 7, 100])
def test_json_as_it_arrives(size):
    cells = [{"x": {"type": "literal", "value": v}} for v in ("a", 'quo"te', "brace } ] {", "back\\slash", "\u00e9\u2028", "end,]")] + [{}, {"x": {"type": "uri", "value": "http://a/[b]"}}]
    doc = {"head": {"vars": ["x", "y"], "link": ["bindings", "results"]}, "results": {"ordered": False, "bindings": cells}}
    late = {"results": doc["results"], "head": doc["head"]}
    want = results_text.parse_json(json.dumps(doc))[1]
    want = [*want]
    for text in (json.dumps(doc), json.dumps(doc, indent=2), json.dumps(late), json.dumps(doc).replace("}}]", "}},]").replace("]}}", "],},}")):
        names, rows = results_text.stream_json(Slow(text, size))
        assert names == ["x", "y"] and [*rows] == want
    assert [*results_text.stream_json(Slow('{"head": {}, "boolean": true}', size))[1]] == [()]
    assert [*results_text.stream_json(Slow('{"boolean": "false"}', size))[1]] == []
    for bad in ('{"head": {"vars": ["x"]}, "results": {"bindings": [{"x": {"type": "literal", "value": "a', "{1: 2}", '{"odd": 1}', "no json"):
        with pytest.raises(MalformedResults):
            [*results_text.stream_json(Slow(bad, size))[1]]


def test_rows_come_before_the_answer_ends():
    cell = '{"x": {"type": "literal", "value": "%d"}}'
    stream = Slow('{"head": {"vars": ["x"]}, "results": {"bindings": [' + ", ".join(cell % i for i in range(5000)) + "]}}", 1000)
    _, rows = results_text.stream_json(stream)
    assert next(rows) == ('"0"',) and stream.given < 3000 and len([*rows]) == 4999


def test_lines_equal_to_the_header_are_rows(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("?x\n?x\n?x\n<http://a>\n")
    got = Counter(r.x for r in api.run(Leaf(ResultsFileSource(spark, str(tmp_path / "r.tsv"))), spark).collect())
    assert got == Counter({'"?x"': 2, "<http://a>": 1})


@pytest.mark.parametrize("size", [1, 2, 3, 16, 10_000])
def test_web_socket_conversation(size):
    talk = Conversation("SELECT ?o WHERE {?s <p> ?o}", ["s"], [["<a>"], ["<b>"], [None]])
    assert talk.start() == ["!bind SELECT ?o WHERE {?s <p> ?o}\n", "?s\n"]
    script = "?o\n!action-queue-cap=16\n!bind-request +2\n!active-binding <a>\n1\n2\n!ping\n!active-binding <b>\n!bind-request +5\n!active-binding \n<x>\n!end\n"
    sent = []
    for at in range(0, len(script), size):
        sent += talk.feed(script[at : at + size])
    assert sent == ["<a>\n", "<b>\n", "!ping-ack\n", "\n", "!end\n"]
    assert talk.vars == ["o"] and talk.rows == [(0, (num(1),)), (0, (num(2),)), (2, ("<x>",))] and talk.ended and talk.capacity == 16


def test_web_socket_errors():
    with pytest.raises(ServerError, match="went wrong"):
        Conversation("ASK {}").feed("!error went wrong\n")
    with pytest.raises(MalformedResults):
        Conversation("ASK {}").feed("?x\n<a>\t<b>\n")
    with pytest.raises(MalformedResults):
        Conversation("ASK {}").feed("!what\n")
    talk = Conversation("ASK {}")
    assert talk.start() == ["!query ASK {}\n"] and talk.feed("\n\n!cancelled\n") == [] and talk.rows == [(None, ())] and talk.cancelled and talk.cancel() == []


class WebSocketServer(threading.Thread):
    """Speaks the line protocol over a real connection: bindings of ``s`` against ``Handler.data``."""

    def __init__(self):
        super().__init__(daemon=True)
        import socket

        self.listen = socket.create_server(("127.0.0.1", 0))
        self.port = self.listen.getsockname()[1]
        self.start()

    def run(self):
        while True:
            link, _ = self.listen.accept()
            threading.Thread(target=self.serve, args=(link,), daemon=True).start()

    def serve(self, link):
        import base64
        import hashlib
        import struct

        file = link.makefile("rb")
        head = b""
        while not head.endswith(b"\r\n\r\n"):
            head += file.read(1)
        if b"/refuse" in head:
            return link.sendall(b"HTTP/1.1 403 No\r\n\r\n")
        key = [x.split(b":")[1].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"sec-websocket-key")][0]
        accept = base64.b64encode(hashlib.sha1(key + b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11").digest())
        link.sendall(b"HTTP/1.1 101 Switching Protocols\r\nSec-WebSocket-Accept: " + accept + b"\r\n\r\n")

        def send(text, code=1):
            body = text.encode()
            link.sendall(bytes([128 | code]) + (bytes([len(body)]) if len(body) < 126 else struct.pack(">BH", 126, len(body))) + body)

        def receive():
            first, second = file.read(2)
            n = second & 127
            n = struct.unpack(">H", file.read(2))[0] if n == 126 else n
            mask = file.read(4)
            return first & 15, bytes(b ^ mask[i % 4] for i, b in enumerate(file.read(n))).decode("utf-8", "replace")

        verb = receive()[1]
        header = verb.startswith("!bind") and receive()[1]
        send("are you there", 9)
        if receive() != (10, "are you there"):
            return link.close()
        ask = " ASK" in verb
        if verb.startswith("!query"):
            send("?s\t?o\n" + "".join("\t".join(r) + "\n" for r in Handler.data) + "!end\n")
        elif header == "?s\n":
            send("\n" if ask else "?o\n")
            while True:
                send("!bind-request +1\n")
                row = receive()[1]
                if row == "!end\n":
                    break
                send(f"!active-binding {row}")
                for s, o in Handler.data:
                    if row.strip() in ("", s):
                        send("\n" if ask else o + "\n")
            send("!end\n")
        receive()


def test_web_socket_endpoint(spark):
    uri = f"ws://127.0.0.1:{WebSocketServer().port}/sparql"
    leaf = Leaf(EndpointSource(uri, "SELECT ?s ?o WHERE {?s <p> ?o}"))
    assert Counter(tuple(r) for r in api.run(leaf, spark).collect()) == Counter(Handler.data)
    left = spark.createDataFrame([("<s1>", "<x>"), ("<s3>", "<y>")], "s string, k string").coalesce(1)
    run = lambda kind: Counter(tuple(r) for r in bind_join(left, uri, "SELECT ?s ?o WHERE {?s <p> ?o}", kind).collect())
    assert run("join") == Counter([("<s1>", "<x>", '"a"'), ("<s1>", "<x>", '"b"')])
    assert run("left_join") == Counter([("<s1>", "<x>", '"a"'), ("<s1>", "<x>", '"b"'), ("<s3>", "<y>", None)])
    assert run("exists") == Counter([("<s1>", "<x>")]) and run("not_exists") == run("minus") == Counter([("<s3>", "<y>")])
    with pytest.raises(ServerError, match="403"):
        list(__import__("mergrove.sources.endpoint", fromlist=["rows"]).rows(Endpoint.parse(uri.replace("sparql", "refuse")), "ASK {}", []))
