"""The graph engine against brute force on a random graph, its refusals, and the roster's SQL."""

import random
from collections import Counter

import duckdb
import pytest

from trellis import roster
from trellis.engine import Engine
from trellis.errors import QueryError, SemanticProblem, SyntaxProblem, Unsupported
from trellis.plans.parser import parse
from trellis.sources import delimited
from trellis.sources.graph import PropertyGraph
from trellis.traversal import gte, traverse

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(3)
    people = [(i, r.choice([None, r.randint(0, 9)]), f"n{i % 4}") for i in range(14)]
    knows = [(r.randrange(14), r.randrange(14)) for _ in range(30)]
    g = PropertyGraph(spark).add_vertices("person", spark.createDataFrame(people, "id long, age long, name string"), "id")
    g.add_edges("knows", "person", "person", spark.createDataFrame(knows, "a long, b long"), "a", "b")
    return Engine(g), people, knows


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_expand_directions_and_parallel_edges(world):
    e, _, knows = world
    assert bag(e.run("MATCH (a:person)-[:knows]->(b) RETURN a.id AS a, b.id AS b")) == Counter(knows)
    both = Counter(knows) + Counter((b, a) for a, b in knows)
    assert bag(e.run("MATCH (a:person)-[:knows]-(b) RETURN a.id AS a, b.id AS b")) == both


def test_walks(world):
    e, _, knows = world
    out = Counter()
    for a, b in knows:
        out[a, b] += 1
        for c, d in knows:
            if b == c:
                out[a, d] += 1
    assert bag(e.run("MATCH (a)-[:knows*1..2]->(b) RETURN a.id AS a, b.id AS b")) == out


def test_walks_without_bound(spark):
    """A chain of 14 edges with a double edge at its start, every length of walk; a cycle is an error."""
    line = [(i, i + 1) for i in range(14)] + [(0, 1)]
    v = spark.createDataFrame([(i,) for i in range(15)], "id long")
    g = PropertyGraph(spark).add_vertices("v", v, "id").add_edges("to", "v", "v", spark.createDataFrame(line, "a long, b long"), "a", "b")
    g.add_edges("round", "v", "v", spark.createDataFrame([(0, 1), (1, 0)], "a long, b long"), "a", "b")
    e = Engine(g)
    for low in (0, 1, 11):
        want = Counter({(a, b): 2 if a == 0 and b > 0 else 1 for a in range(15) for b in range(a + low, 15)})
        assert bag(e.run(f"MATCH (a:v)-[:to*{low}..]->(b) RETURN a.id AS a, b.id AS b")) == want
    with pytest.raises(QueryError):
        Engine(g, max_hops=5).run("MATCH (a:v)-[:round*]->(b) RETURN a.id AS a").count()


def test_walks_roster_without_bound(spark):
    orders = duckdb.sql(f"SELECT * FROM read_parquet('{SF}/orders.parquet')")
    want = Counter(orders.query("orders", roster.SQL["varlen_unbounded_all"]).fetchall())
    assert bag(roster.QUERIES["varlen_unbounded_all"](spark, SF)) == want


def test_patterns_and_optional(world):
    e, people, knows = world
    starts = {a for a, _ in knows}
    assert bag(e.run("MATCH (a:person) WHERE NOT (a)-[:knows]->() RETURN a.id AS a")) == Counter((p[0],) for p in people if p[0] not in starts)
    assert bag(e.run("MATCH (a:person) WHERE (a)-[:knows]->() OR a.age > 5 RETURN a.id AS a")) == Counter((p[0],) for p in people if p[0] in starts or (p[1] or 0) > 5)
    age = {p[0]: p[1] for p in people}
    want = Counter()
    for i, own, _ in people:
        hits = [b for a, b in knows if a == i and own is not None and age[b] is not None and age[b] > own]
        want.update([(i, b) for b in hits] or [(i, None)])
    assert bag(e.run("MATCH (a:person) OPTIONAL MATCH (a)-[:knows]->(b) WHERE b.age > a.age RETURN a.id AS a, b.id AS b")) == want


def test_closing_edge_modes(world):
    e, _, knows = world
    q = "MATCH (a)-[:knows]->(b), (a)-[:knows]->(b) RETURN count(*) AS n"
    c = Counter(knows)
    assert e.run(q).first()[0] == sum(v * v for v in c.values())
    assert Engine(e.graph, into="exists").run(q).first()[0] == len(knows)


@pytest.mark.parametrize(("text", "kind"), [
    ("MATCH (n) WHERE", SyntaxProblem), ("MATCH (n)", SemanticProblem), ("MATCH (n) RETURN sum(count(n))", SemanticProblem), ("MATCH (n) RETURN n.age + count(n)", SemanticProblem),
    ("MATCH (n) RETURN m.age", SemanticProblem), ("MATCH (n) RETURN (n)-->()", SemanticProblem), ("MATCH (n) RETURN (n.age = 1) + 2", SemanticProblem), ("MATCH (n) WITH n.age RETURN 1", SemanticProblem),
    ("UNWIND [1] AS x RETURN x", QueryError), ("CREATE (n) RETURN n", Unsupported), ("MATCH (n) RETURN n.age LIMIT n", SyntaxProblem), ("MATCH (n:a:b) RETURN n", Unsupported),
    ("MATCH (a)-[r:knows]->(b)-[r:knows]->(c) RETURN a", Unsupported), ("OPTIONAL MATCH (n) RETURN n", Unsupported), ("MATCH (n) RETURN upper(n.name)", Unsupported), ("MATCH (n) WITH n.age AS x RETURN n.age", SemanticProblem),
    ("MATCH (n) WHERE count(n) > 1 RETURN n", SemanticProblem), ("MATCH (n) RETURN $x AS x", SemanticProblem), ("", SyntaxProblem),
])
def test_refusals(world, text, kind):
    with pytest.raises(kind):
        world[0].run(text)


def test_scalar_rules(world):
    row = world[0].run("MATCH (a {id: 0}) RETURN -7 / 2 AS q, -7 % 3 AS r, 1 / 0 AS z, 'a' < 1 AS c, 'a' = 1 AS d, 'a' + 'b' AS s, 1 < 2 < 3 AS t, null = null AS n, NOT 0 AS f, 0.1 + 0.2 = 0.3 AS eps").first()
    assert tuple(row) == (-3, -1, None, None, False, "ab", True, None, True, True)


def test_last_statement_and_comments():
    assert parse("MATCH (n) RETURN n; // first\n MATCH (m) RETURN m AS x")[1].items[0].name == "x"


def test_index_and_explain(world):
    e = world[0]
    assert "built" in e.run("CREATE INDEX ON :person(age)").first()[0]
    assert "Physical Plan" in e.explain("MATCH (a:person) WHERE a.age > 3 RETURN a.id AS a")
    assert "dropped" in e.run("DROP INDEX ON :person(age)").first()[0]
    with pytest.raises(QueryError):
        e.run("DROP INDEX ON :person(age)")


def test_traversal(world):
    e, people, knows = world
    age = {p[0]: p[1] for p in people}
    n = sum(1 for _, b in knows if age[b] is not None and age[b] >= 4)
    assert traverse(e.graph).V("person").out("knows").has("age", gte(4)).count().to_df().first()[0] == n


def test_delimited(spark, tmp_path):
    (tmp_path / "v.csv").write_text("id:id|name:string|old:bool\n1|a|TRUE\n2||no\n")
    (tmp_path / "e.csv").write_text("a:start_id|b:end_id|w:float\n1|2|0.5\n")
    v, ed = str(tmp_path / "v.csv"), str(tmp_path / "e.csv")
    g = delimited.load(spark, [("p", [v])], [("k", [ed])], {"k": ("p", "p")})
    rows = Engine(g).run("MATCH (a:p)-[k:k]->(b) RETURN a.name AS a, a.old AS o, b.name AS b, k.w AS w").collect()
    assert [tuple(r) for r in rows] == [("a", True, None, 0.5)]
    (tmp_path / "e.csv").write_text("a:start_id|b:end_id|w:float\n1|9|0.5\n")
    with pytest.raises(QueryError):
        delimited.load(spark, [("p", [v])], [("k", [ed])], {"k": ("p", "p")})


def test_degrees_and_histogram(world):
    e, people, knows = world
    d = {r["id"]: r["degree"] for r in e.graph.degrees("person", "knows", "both").collect()}
    assert d == {p[0]: sum((a == p[0]) + (b == p[0]) for a, b in knows) for p in people}
    assert e.graph.histogram(e.graph.degrees("person"), "degree", (0, 100), exact=True)[1] == max(Counter(a for a, _ in knows).values())


@pytest.mark.parametrize("name", ["flagship", "null_tests", "arith_exprs", "agg_distinct", "with_chain", "pattern_or_prop", "optional_count", "varlen_1_2", "order_skip_limit", "bench_ac6"])
def test_roster(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    r = con.sql(roster.SQL[name])
    df = roster.QUERIES[name](spark, SF).select(*r.columns)
    fix = lambda rows: sorted((tuple(round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in row) for row in rows), key=str)
    assert fix(r.fetchall()) == fix(map(tuple, df.collect()))


@pytest.mark.parametrize("name", ["expand_both_all", "expand_both_same_label_all", "expand_untyped_all", "with_distinct_all", "cartesian_all", "varlen_0_1_all", "varlen_1_2_all"])
def test_roster_whole_tables(spark, name):
    test_roster(spark, name)


def test_loader_groups_and_labels(spark, tmp_path):
    """Two groups of one label are united; rows without a label, or of another than the group's, are refused."""
    (tmp_path / "a").write_text("x:id|name\n1|one\n")
    (tmp_path / "b").write_text("x:id|name\n2|two\n")
    (tmp_path / "c").write_text("x:id|kind:label\n3|p\n4|q\n")
    (tmp_path / "d").write_text("x:id|kind:label\n5|p\n6|\n")
    at = lambda n: f"{tmp_path}/{n}"
    g = delimited.load(spark, [("p", [at("a")]), ("p", [at("b")])], [], {})
    assert bag(Engine(g).run("MATCH (n:p) RETURN n.x AS x, n.name AS name")) == Counter([(1, "one"), (2, "two")])
    assert set(delimited.load(spark, [(None, [at("c")])], [], {}).vertices) == {"p", "q"}
    for groups in ([("p", [at("c")])], [(None, [at("d")])]):
        with pytest.raises(QueryError):
            delimited.load(spark, groups, [], {})


def test_sums_of_text_are_refused(world):
    e, _, _ = world
    for q in ("sum(a.name)", "avg(a.name)"):
        with pytest.raises(SemanticProblem):
            e.run(f"MATCH (a:person) RETURN {q} AS s")


def test_dropped_index_is_freed(spark):
    g = PropertyGraph(spark).add_vertices("v", spark.range(20).withColumnRenamed("id", "k"), "k")
    e = Engine(g)
    e.run("CREATE INDEX ON :v(k)")
    kept = g._cached["v", "k"]
    assert kept.is_cached and e.run("MATCH (a:v) WHERE a.k < 3 RETURN a.k AS k").count() == 3
    e.run("DROP INDEX ON :v(k)")
    assert not kept.is_cached and e.run("MATCH (a:v) WHERE a.k < 3 RETURN a.k AS k").count() == 3


def test_stored_edges_meet_by_either_end(spark):
    from trellis.sources.graph import stored

    pairs = [(1, 2), (1, 3), (2, 3), (3, 1)]
    made = []

    def rows():
        if not made:
            made.append(stored(spark.createDataFrame(pairs, "__src long, __dst long")))
        return made[0]

    v = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    e = Engine(PropertyGraph(spark).add_vertices("v", v, "id").add_stored_edges("to", "v", "v", rows))
    assert not made
    assert bag(e.run("MATCH (a:v)<-[:to]-(b) RETURN a.id AS a, b.id AS b")) == Counter((b, a) for a, b in pairs)
    assert bag(e.run("MATCH (a:v)-[:to*2..2]->(b) RETURN a.id AS a, b.id AS b")) == Counter((a, d) for a, b in pairs for c, d in pairs if b == c)


def test_closing_through_a_hub_comes_last(spark, tmp_path):
    """2,000 customers and 1,000 suppliers of one nation: their 2,000,000 pairs are not made to find the 1,000 orders that join them."""
    n, q = 2000, "MATCH (c:c)-[:lives]->(n)<-[:based]-(s:s), (c)-[:placed]->(o)-[:by]->(s) RETURN c.k AS c, s.k AS s, o.k AS o"
    rows = {"c": [(i, 0) for i in range(n)], "s": [(i, i % 2) for i in range(n)], "o": [(i, (i * 7) % n) for i in range(n)], "n": [(0, 0), (1, 0)]}
    g = PropertyGraph(spark)
    for label, r in rows.items():
        spark.createDataFrame(r, "k long, x long").coalesce(1).write.parquet(f"{tmp_path}/{label}")
        g.add_vertices(label, spark.read.parquet(f"{tmp_path}/{label}"), "k")
    t = lambda label: spark.read.parquet(f"{tmp_path}/{label}")
    g.add_edges("lives", "c", "n", t("c"), "k", "x").add_edges("based", "s", "n", t("s"), "k", "x").add_edges("placed", "c", "o", t("o"), "x", "k").add_edges("by", "o", "s", t("o"), "k", "k")
    assert bag(Engine(g).run(q)) == Counter((x, k, k) for k, x in rows["o"] if k % 2 == 0)
    assert max(m.get("numOutputRows", 0) for _, m in Engine(g).profile(q)) <= n


def test_stored_edges_are_told_apart_in_bounded_slices(spark, monkeypatch):
    """600 pairs, some of them three times: stored once, sorted, and in slices that don't grow with the table."""
    from trellis.sources import graph

    monkeypatch.setattr(graph, "SLICE", 100)
    pairs = [(a, b) for a in range(30) for b in range(20)]
    src, dst = graph.stored(spark.createDataFrame(pairs + pairs[::2] * 2, "__src long, __dst long"), distinct=True)
    for rows, end in ((src, 0), (dst, 1)):
        parts = [spark.read.parquet(f).collect() for f in rows.inputFiles()]
        assert bag(rows) == Counter(pairs) and max(map(len, parts)) <= 200
        assert all([r[end] for r in p] == sorted(r[end] for r in p) for p in parts)


@pytest.fixture(params=["small", "large"])
def web(spark, request, monkeypatch):
    """A random graph of stored edges, taken for small ones or for large ones."""
    from trellis.operators import graph_ops
    from trellis.sources import graph

    monkeypatch.setattr(graph, "LARGE", 0 if request.param == "large" else 1 << 60)
    monkeypatch.setattr(graph_ops, "FEW", 5)
    monkeypatch.setattr(graph_ops, "BLOCK", 2)
    r = random.Random(5)
    pairs = sorted({(r.randrange(9), r.randrange(9)) for _ in range(22)})
    age = {i: r.choice([None, 1, 2, 3]) for i in range(9)}
    made = graph.stored(spark.createDataFrame(pairs, "__src long, __dst long"))
    g = PropertyGraph(spark).add_vertices("v", spark.createDataFrame(list(age.items()), "id long, age long"), "id").add_stored_edges("to", "v", "v", lambda: made)
    return Engine(g), age, pairs + [(b, a) for a, b in pairs]


def test_walks_whose_start_is_not_returned(web):
    """Counted walks give the rows, counts and sums of listed ones."""
    e, age, both = web
    one, two = Counter(both), Counter((a, d) for a, b in both for c, d in both if b == c)
    w = one + two
    assert bag(e.run("MATCH (a:v {id: 1})-[:to*1..2]-(b) RETURN b.id AS b")) == Counter({(b,): n for (a, b), n in w.items() if a == 1})
    assert bag(e.run("MATCH (a:v {id: 1})-[:to*2..2]-(b) RETURN b.id AS b ORDER BY b SKIP 1")) == Counter(sorted((b,) for (a, b), n in two.items() for _ in range(n) if a == 1)[1:])
    ends = Counter(range(9))
    for (_, b), n in w.items():
        ends[b] += n
    assert bag(e.run("MATCH (a:v)-[:to*0..2]-(b) RETURN b.id AS b, count(*) AS n, count(b.age) AS m, max(b.age) AS x")) == Counter((b, n, n if age[b] else 0, age[b]) for b, n in ends.items())
    assert e.run("MATCH (a:v)-[:to*1..2]-(b) RETURN sum(b.age) AS s").first()[0] == sum(n * (age[b] or 0) for (_, b), n in w.items())
    assert e.run("MATCH (a:v)-[:to*1..2]-(b) WHERE b.age > 9 RETURN count(b) AS n").first()[0] == 0
    assert bag(e.run("MATCH (a:v {id: 2})-[:to]-(b) RETURN b.id AS b")) == Counter({(b,): n for (a, b), n in one.items() if a == 2})


@pytest.mark.parametrize("text", [
    "MATCH (a:v)-[:to*1..2]-(b)-[:to*1..2]->(c) RETURN c.id AS c", "MATCH (a:v {id: 3})-[:to*1..3]->(b) WHERE NOT (b)-[:to]->(b) RETURN b.id AS b, b.age AS g", "MATCH (a:v {id: 2}), (c:v)-[:to*0..2]->(b) RETURN b.id AS b, c.id AS c",
    "MATCH (a:v {id: 1})-[:to*1..2]-(b) MATCH (b)-[:to]-(c) RETURN b.id AS b, c.id AS c", "MATCH (a:v {id: 3})-[:to*1..2]->(b), (b)-[:to]->(c)<-[:to*1..1]-(b) RETURN c.age AS c", "MATCH (c:v) OPTIONAL MATCH (a:v {id: 2})-[:to*2..2]-(b) WHERE b.age > c.age RETURN c.id AS c, b.id AS b",
])
def test_walks_whose_start_is_dropped(web, text):
    assert bag(web[0].run(text)) == bag(web[0].run(text + ", a.id AS zz").drop("zz"))


def test_walks_from_everywhere_are_not_listed(spark, tmp_path):
    """40 vertices, each with an edge to each other: 60,840 walks of two edges, counted from 1,560 edges."""
    from trellis.sources.graph import stored

    made = stored(spark.createDataFrame([(a, b) for a in range(40) for b in range(a)], "__src long, __dst long"))
    e = Engine(PropertyGraph(spark).add_vertices("v", spark.range(40), "id").add_stored_edges("to", "v", "v", lambda: made))
    q = "MATCH (a:v)-[:to*1..2]-(b) RETURN b.id AS b, count(b) AS n"
    assert bag(e.run(q)) == Counter((b, 39 + 39 * 39) for b in range(40))
    assert max(m.get("numOutputRows", 0) for _, m in e.profile(q)) <= 1560


def test_few_rows_meet_large_edges_where_they_lie(web):
    """From a picked vertex the edges are not shuffled."""
    e = web[0]
    large = e.graph.edges[0].large
    for q in ("MATCH (a:v {id: 1})-[:to*1..1]-(b) RETURN b AS b", "MATCH (a:v {id: 1})-[:to]-(b) RETURN b AS b"):
        spark = e.graph.spark
        was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            assert ("SortMergeJoin" in e.explain(q)) != large
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_console(world, tmp_path):
    from trellis.console import Console, split

    e, people, knows = world
    c = Console(e)
    assert c.execute("MATCH (a:person) RETURN count(a) AS n") == f"n\n{len(people)}\n[1 rows]"
    assert "quit" in c.execute("help") and "error" in c.execute("MATCH (a") and c.execute("  ") == ""
    assert "Scan" in c.execute("explain MATCH (a:person) RETURN a.id AS a")
    assert c.execute("config rows 1") == "rows = 1" and "no setting" in c.execute("config x 1")
    assert c.execute("MATCH (a:person) RETURN a.id AS a").count("\n") == 2
    c.execute(f"dump {tmp_path}/out MATCH (a:person) RETURN a.id AS a")
    lines = [x for p in (tmp_path / "out").glob("*.csv") for x in p.read_text().split("\n")[1:] if x]
    assert sorted(map(int, lines)) == sorted(p[0] for p in people)
    (tmp_path / "f").write_text("// a comment; here\nMATCH (a:person) WHERE a.name = 'n;1' RETURN count(a) AS n;\nRETURN 2 AS two")
    assert split((tmp_path / "f").read_text()) == ["MATCH (a:person) WHERE a.name = 'n;1' RETURN count(a) AS n", "RETURN 2 AS two"]
    assert c.execute(f"source {tmp_path}/f") == "n\n0\n[1 rows]\ntwo\n2\n[1 rows]"
    steps = e.profile("MATCH (a:person)-[:knows]->(b) RETURN a.id AS a")
    assert any(m.get("numOutputRows") == len(knows) for _, m in steps)


def test_throughput(world, tmp_path):
    from trellis import throughput as t

    e, people, _ = world
    (tmp_path / "conf").write_text("[Config]\ntestTime= 1\n# one\nMATCH (a:person {id:$RAND}) RETURN a.name AS n|person|id|3|5000|both|knows\n# none\nMATCH (a:person) RETURN x|||1|1000\n")
    settings, templates = t.read(f"{tmp_path}/conf")
    assert settings == {"testTime": "1"} and [x.name for x in templates] == ["one", "none"] and templates[0].edge == "knows"
    r = t.run(e, templates, rate=6, seconds=1, workers=3)
    one, none = r["templates"]["one"], r["templates"]["none"]
    assert one["runs"] + one["errors"] + none["errors"] == 6 and none["runs"] == 0 and one["p50"] <= one["p99"]
    assert t.percentile([3, 1, 2, 4], 50) == 2 and t.percentile([], 50) == 0.0
