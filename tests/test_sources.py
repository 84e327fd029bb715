"""Files, endpoints, seeds, datasets and sinks, by round trips."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from kgloom import sinks
from kgloom.sources import datasets, endpoints, rdf, seeds

X = "http://x/"
TURTLE = """@prefix x: <http://x/> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
@base <http://x/> . # a comment
x:a a x:Cat ; x:name "A \\"b\\" \\u00e9"@EN, 'c' ; x:age 5, 1.5, 2e3 ; x:ok true ; .
<b> x:knows [ x:name \"\"\"long
text\"\"\" ; x:near _:k ], _:k .
x:c x:list ( x:a "two" ) ; x:day "2020-01-01"^^xsd:date .
"""
XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x/" xml:base="http://x/base">
  <x:Cat rdf:about="http://x/a" x:colour="red"><x:name xml:lang="EN">A b</x:name><x:knows rdf:resource="http://x/b"/><x:age rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</x:age></x:Cat>
  <rdf:Description rdf:ID="c"><x:friend><x:Dog rdf:nodeID="d"/></x:friend><x:part rdf:parseType="Resource"><x:name>p</x:name></x:part>
    <x:list rdf:parseType="Collection"><rdf:Description rdf:about="http://x/a"/></x:list></rdf:Description>
</rdf:RDF>"""


def triples(df):
    return sorted(tuple(r) for r in df.select("s", "p", "o", "is_lit", "o_dt", "o_lang").collect())


def test_ntriples_with_escapes_types_and_bad_lines(spark, tmp_path):
    lines = [
        "# comment",
        "",
        f'<{X}a> <{X}p> <{X}b> .',
        f'<{X}a> <{X}p> <{X}b> . # again',
        f'_:n <{X}p> "a\\tb \\"q\\" \\\\n \\u00e9 \\U0001F600"@en-GB .',
        f'<{X}a> <{X}n> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .',
        f'<{X}a> <{X}q> _:n.1 .',
        f'<{X}a> <{X}e> "" .',
    ]
    (tmp_path / "g.nt").write_text("\n".join(lines), encoding="utf-8")
    got = triples(rdf.ntriples(spark, str(tmp_path / "g.nt")).na.fill("", ["o_dt", "o_lang"]))
    xsd = "http://www.w3.org/2001/XMLSchema#integer"
    want = [(X + "a", X + "p", X + "b", False, "", ""), ("_:n", X + "p", 'a\tb "q" \\n é 😀', True, "", "en-gb"), (X + "a", X + "n", "5", True, xsd, ""), (X + "a", X + "q", "_:n.1", False, "", ""), (X + "a", X + "e", "", True, "", "")]
    assert got == sorted(want)
    (tmp_path / "bad.nt").write_text(f'<{X}a> <{X}p> <{X}b> .\n<{X}a> <{X}p> oops .\n', encoding="utf-8")
    with pytest.raises(Exception, match="not a triple"):
        rdf.ntriples(spark, str(tmp_path / "bad.nt")).collect()
    assert rdf.ntriples(spark, str(tmp_path / "bad.nt"), "skip").count() == 1 == rdf.bad_ntriples(spark, str(tmp_path / "bad.nt")).count()
    rdf.write_ntriples(rdf.ntriples(spark, str(tmp_path / "g.nt")), str(tmp_path / "again"))
    assert triples(rdf.ntriples(spark, str(tmp_path / "again")).na.fill("", ["o_dt", "o_lang"])) == got


def test_turtle(spark, tmp_path):
    got = rdf.parse_turtle(TURTLE, "m")
    plain = {(s, p.removeprefix(X), o, lit) for s, p, o, lit, *_ in got if p.startswith(X)}
    assert {(X + "a", "name", 'A "b" é', True), (X + "a", "name", "c", True), (X + "a", "age", "5", True), (X + "a", "age", "1.5", True), (X + "a", "age", "2e3", True), (X + "a", "ok", "true", True), (X + "b", "knows", "_:k", False)} <= plain
    assert (X + "a", rdf.RDF + "type", X + "Cat", False, None, None) in got
    assert {dt for s, p, o, lit, dt, _ in got if lit} >= {rdf.XSD + k for k in ("integer", "decimal", "double", "boolean", "date")}
    (blank,) = [o for s, p, o, *_ in got if p == X + "knows" and o != "_:k"]
    assert (blank, X + "name", "long\ntext", True, None, None) in got and (blank, X + "near", "_:k", False, None, None) in got
    assert [o for _, p, o, *_ in got if p == rdf.RDF + "first"] == ["two", X + "a"] or [o for _, p, o, *_ in got if p == rdf.RDF + "first"] == [X + "a", "two"]
    for broken in ("x:a x:b x:c .", "<a> <b> ", '<a> <b> "c', "<a> <b> ; ."):
        with pytest.raises(ValueError):
            rdf.parse_turtle(broken)
    (tmp_path / "g.ttl").write_text(TURTLE, encoding="utf-8")
    assert rdf.load_graph(spark, str(tmp_path / "g.ttl"), "ttl").count() == len(set(got))
    with pytest.raises(ValueError, match="unknown format"):
        rdf.load_graph(spark, "x", "json")


def test_rdfxml(spark, tmp_path):
    got = rdf.parse_rdfxml(XML, "m")
    assert {(X + "a", rdf.RDF + "type", X + "Cat", False, None, None), (X + "a", X + "colour", "red", True, None, None), (X + "a", X + "name", "A b", True, None, "en"), (X + "a", X + "knows", X + "b", False, None, None), (X + "a", X + "age", "5", True, rdf.XSD + "integer", None)} <= set(got)
    assert (X + "base#c", X + "friend", "_:d", False, None, None) in got and ("_:d", rdf.RDF + "type", X + "Dog", False, None, None) in got
    (part,) = [o for s, p, o, *_ in got if p == X + "part"]
    assert (part, X + "name", "p", True, None, None) in got
    assert [o for _, p, o, *_ in got if p == rdf.RDF + "first"] == [X + "a"]
    (tmp_path / "g.xml").write_text(XML, encoding="utf-8")
    assert rdf.load_graph(spark, str(tmp_path / "g.xml"), "xml").count() == len(set(got))


def test_endpoint(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
            if "fail" in asked["query"][0]:
                self.send_error(500)
                return
            value = {"value": asked["query"][0], "type": "uri"}
            body = json.dumps({"head": {}, "results": {"bindings": [{"s": value, "o": {"value": asked["reasoning"][0], "type": "literal"}}, {"s": value}]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/"
        got = endpoints.ask(spark, url, ["q1", "q2", "fail"], ["s", "o"], wait="0", failed="skip", reasoning="true", queries_a_task="1").collect()
        assert sorted((r.s, r.s_kind, r.o, r.o_kind) for r in got if r.o) == [("q1", "uri", "true", "literal"), ("q2", "uri", "true", "literal")] and len(got) == 4
        with pytest.raises(Exception, match="500"):
            endpoints.ask(spark, url, ["fail"], ["s"], wait="0").collect()
    finally:
        server.shutdown()
    broken = spark.createDataFrame([("no json",), (None,)], "answer string")
    assert endpoints.bindings(broken, "answer", ["s"]).count() == 0


def test_seeds(spark, tmp_path):
    graph = spark.createDataFrame([("a", "p", "b", False), ("b", "p", "a", False), ("a", "q", "c", False), ("c", "p", "c", False)], "s string, p string, o string, is_lit boolean")
    assert sorted(tuple(r) for r in seeds.match(graph, [("?x", "p", "?y"), ("?y", "p", "?x")]).collect()) == [("a", "b"), ("b", "a"), ("c", "c")]
    assert [r.x for r in seeds.match(graph, [("?x", "p", "?x")]).collect()] == ["c"]
    with pytest.raises(ValueError, match="shares no variable"):
        seeds.match(graph, [("?x", "p", "?y"), ("?z", "q", "?w")])
    (tmp_path / "s.txt").write_text("http://a \nhttp://b\nhttp://b\n")
    named = lambda df: sorted(r.noi for r in df.collect())
    assert named(seeds.acquire(spark, graph, str(tmp_path / "s.txt"))) == ["<http://a>", "<http://b>"]
    assert named(seeds.acquire(spark, graph, {"x", "y"})) == ["x", "y"]
    assert named(seeds.acquire(spark, graph, [("?s", "q", "c")])) == ["a"]
    assert named(seeds.sample(seeds.from_list(spark, map(str, range(50))), 5, 1)) == named(seeds.sample(seeds.from_list(spark, map(str, range(50))), 5, 1))
    nodes = seeds.from_list(spark, ["<a>", "zz"])
    source = endpoints.GraphTable(graph)
    assert sorted((r.noi, r.p, r.o) for r in source.forward(nodes).collect()) == [("<a>", "p", "b"), ("<a>", "q", "c")]
    assert [(r.noi, r.p, r.o) for r in source.inverse(nodes).collect()] == [("<a>", "p", "b")]


def test_datasets(spark, tmp_path):
    (tmp_path / "train.tsv").write_bytes("id\tthing\tkind\n1\thttp://é\tx\n2\thttp://b\t\n".encode("latin-1"))
    (tmp_path / "test.tsv").write_text("id\tthing\tkind\n3\thttp://c\ty\n", encoding="utf-8")
    train, test = (datasets.label_table_any(spark, str(tmp_path / f), "thing", "kind") for f in ("train.tsv", "test.tsv"))
    both = datasets.train_and_test(train, test)
    assert sorted(tuple(r) for r in both.collect()) == [("http://c", "y", "test"), ("http://é", "x", "train")]
    with pytest.raises(FileNotFoundError):
        datasets.label_table(spark, str(tmp_path / "none.tsv"), "thing", "kind")
    for part, rows in (("train", "1,0.5\n"), ("test", "2,1.5\n")):
        (tmp_path / f"SET_TFF_{part}.csv").write_text("index,f\n" + rows)
    assert datasets.feature_tables(spark, str(tmp_path), "SET", "_TFF").count() == 2
    (tmp_path / "hard.csv").write_text("item,difficult\na,0.5\nb,x\n")
    assert sorted((r.item, r.difficult) for r in datasets.difficulty_table(spark, str(tmp_path / "hard.csv")).collect()) == [("a", 0.5), ("b", None)]
    (tmp_path / "folds").mkdir()
    for k in (1, 2):
        (tmp_path / "folds" / f"Difficult_result_1.0_{k}.csv").write_text(f"item,sign,difficult,predict,loss,detail\ni{k},1,0.5,0,0.25,0\n", encoding="utf-8-sig")
    (tmp_path / "folds" / "other.csv").write_text("a\n1\n")
    got = datasets.fold_results(spark, str(tmp_path / "folds"))
    assert sorted((r.item, r.fold, r.detail) for r in got.collect()) == [("i1", 1, 0), ("i2", 2, 0)]
    known = datasets.Registry(datasets.DatasetSpec("TOYS", "m.nt", "label", "bond", exclude=("p",)))
    assert known["toys_tff"].item == "bond" == known.item("TOYS1") and known["Toys"].skip("q") == ["p", "q"]
    assert known.with_paths("/d")["toys"].graph == "/d/m.nt"
    with pytest.raises(KeyError, match="unknown dataset"):
        known["none"]
    assert datasets.missing_files(spark, str(tmp_path / "hard.csv"), str(tmp_path / "gone")) == [str(tmp_path / "gone")]


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([("a", "f", 1.0), ("a", "g", 2.0), ("b", "f", 1.0)], "noi string, feature string, val double")
    labels = spark.createDataFrame([("a", 1, "train"), ("b", 0, "test"), ("c", 0, "test")], "noi string, label int, part string")
    sinks.save_features(cells, labels, str(tmp_path / "long"))
    assert spark.read.parquet(str(tmp_path / "long")).where("part = 'train'").count() == 2
    sinks.save_features(cells, labels, str(tmp_path / "wide"), as_csv=True)
    rows = spark.read.csv(str(tmp_path / "wide_test.csv"), header=True)
    assert rows.columns == ["index", "f", "g", "item", "label"] and sorted(tuple(r) for r in rows.collect()) == [("b", "1.0", "0.0", "b", "0"), ("c", "0.0", "0.0", "c", "0")]
    found = spark.createDataFrame([("a", 1, 0.5, 1, 0.1, 1, 0), ("b", 0, 0.5, 1, 0.1, 0, 1)], "item string, sign int, difficult double, predict int, loss double, detail int, fold int")
    sinks.save_folds(found, str(tmp_path / "folds"), errors_only=True)
    assert spark.read.csv(str(tmp_path / "folds"), header=True).count() == 1
    sinks.save_merged(found, str(tmp_path / "merged"))
    assert spark.read.csv(str(tmp_path / "merged"), header=True).count() == 2
    names = spark.createDataFrame([("f", 0), ("g", 1)], "feature string, index long")
    sinks.save_matrix(cells, names, str(tmp_path / "matrix"))
    assert [x.count() for x in sinks.load_matrix(spark, str(tmp_path / "matrix"))] == [3, 2]
    sinks.upload_graph(cells, "kgloom_test_graph")
    assert spark.table("kgloom_test_graph").count() == 3
    sinks.drop_graph(spark, "kgloom_test_graph")
    assert not spark.catalog.tableExists("kgloom_test_graph")
    metrics = spark.createDataFrame([("m", "accuracy", 0.5), ("m", "seconds", 2.0)], "model string, metric string, value double")
    assert tuple(sinks.metric_table(metrics).first()) == ("m", 0.5, None, None, None, 2.0)
    sinks.publish(cells, cells, cells, cells)
    assert spark.sql("SELECT count(*) FROM kg_features").first()[0] == 3
