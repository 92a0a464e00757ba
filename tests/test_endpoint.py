"""Query texts, and a store behind HTTP that answers them."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from lucidgraph.plans import sparql
from lucidgraph.plans.rules import Atom, Rule
from lucidgraph.sources import endpoint

RULE = Rule(Atom("?x", "in", "c1"), (Atom("?x", "p", "?y"), Atom("?y", "?p", "?z")))


def test_texts():
    q = sparql.bindings(RULE, ["http://g1", "http://g2"], 100, 20)
    assert q.startswith("SELECT ?p (COUNT(DISTINCT ?x) AS ?c) FROM <http://g1> FROM <http://g2> WHERE {?x <in> <c1>. ?x <p> ?y. ?y ?p ?z.")
    assert "FILTER(?p != <in>)" in q and "FILTER(?y != ?z)" in q and q.endswith("GROUP BY ?p HAVING (COUNT(DISTINCT ?x) > 100) ORDER BY DESC(?c) ?p LIMIT 20")
    assert "HAVING" not in sparql.bindings(RULE, ["g"]) and "<c2>" in sparql.support(RULE, ["g"], Atom("?x", "in", "c2"))
    assert sparql.anchors(RULE, ["g"], Atom("?x", "in", "?any")).startswith("SELECT DISTINCT ?x FROM <g>")
    same = Rule(Atom("?x", "in", "c"), (Atom("?x", "type", "a"), Atom("?x", "type", "?t")))
    assert "<a> != ?t" in sparql.filters(same)


@pytest.fixture()
def store():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            query = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)["query"][0]
            rows = [{c: {"type": "uri", "value": f"{c}{i}"} for c in "spo"} for i in range(5)]
            if "OFFSET" in query:
                limit, offset = int(query.split("LIMIT ")[1].split()[0]), int(query.split("OFFSET ")[1])
                rows = rows[offset : offset + limit]
            bad = "bad" in query
            body = b"no such thing" if bad else json.dumps({"results": {"bindings": rows}}).encode()
            self.send_response(400 if bad else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_source(spark, store):
    endpoint.register(spark)
    read = spark.read.format("sparql").option("endpoint", store)
    assert sorted(tuple(r) for r in read.option("query", "SELECT").load().collect()) == [(f"s{i}", f"p{i}", f"o{i}") for i in range(5)]
    paged = read.option("query", "SELECT").option("page", 2).option("pages", 3).load()
    assert paged.count() == 5 and paged.rdd.getNumPartitions() == 3
    with pytest.raises(RuntimeError, match="400"):
        endpoint.fetch(store, "bad")
