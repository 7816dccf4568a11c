import random

from pyspark.sql import functions as F

from lodegraph.operators import graph_analytics as ga
from lodegraph.operators import graph_build as gb

NODE = "id int, name string, kind string, file_path string, line_start int, line_end int, language string, detail string"
EDGE = "src int, dst int, kind string"


def graph(spark, nodes, edges):
    n = [(i, name, kind, path, a, z, "rs", None) for i, name, kind, path, a, z in nodes]
    return spark.createDataFrame(n, NODE), spark.createDataFrame(edges, EDGE)


def simple(spark):
    return graph(
        spark,
        [(1, "a", "module", "a.rs", 1, 700), (2, "b", "module", "b.rs", 1, 10), (3, "c", "module", "c.rs", 1, 10), (4, "main", "function", "a.rs", 2, 5), (5, "Cfg::load", "method", "b.rs", 2, 9), (6, "help", "function", "c.rs", 1, 3), (6, "help", "function", "c.rs", 1, 3)],
        [(2, 1, "imports"), (3, 2, "imports"), (4, 5, "calls"), (4, 5, "calls"), (1, 4, "contains"), (6, 5, "calls")],
    )


def test_basics(spark):
    n, e = simple(spark)
    s = ga.graph_stats(n, e).collect()[0]
    assert (s["total_nodes"], s["total_edges"], s["functions"], s["methods"], s["modules"]) == (6, 5, 2, 1, 3)
    assert [(r["id"], r["degree"]) for r in ga.god_nodes(n, e, 2).collect()] == [(5, 2), (4, 1)]
    assert sorted(r["id"] for r in ga.callers(n, e, "load").collect()) == [4, 6]
    assert [r["id"] for r in ga.callees(n, e, "main").collect()] == [5]
    assert [r["id"] for r in ga.file_structure(n, e, "A.rs").collect()] == [4]
    assert [r["id"] for r in ga.orphans(n, e).collect()] == [6]
    assert [r["id"] for r in ga.long_files(n).collect()] == [1]
    assert sorted(r["id"] for r in ga.neighbourhood(e, 5).collect()) == [4, 5, 6]
    assert ga.filter_graph(n, "CFG").count() == 1


def test_blast_radius(spark):
    n, e = simple(spark)
    a = ga.blast_radius(n, e, "a.rs")
    assert sorted(tuple(r) for r in a.collect()) == [("b.rs", 1), ("c.rs", 2)]
    assert ga.blast_risk(a).collect()[0]["risk_score"] == 18
    assert ga.blast_radius(n, e, "nope").count() == 0


def test_health(spark):
    none = graph(spark, [(1, "x", "module", "x", 1, 2)], [(1, 1, "contains")])
    r = ga.health_report(none[0].limit(0), none[1].limit(0)).collect()[0]
    assert (r["score"], r["grade"]) == (100, "A")
    two = graph(spark, [(1, "a", "module", "a", 1, 2), (2, "b", "module", "b", 1, 2)], [(1, 2, "imports"), (2, 1, "imports")])
    r = ga.health_report(*two).collect()[0]
    assert (r["n_cycles"], r["score"], r["grade"]) == (1, 85, "B")


def test_cycles_against_brute_force(spark):
    rng = random.Random(5)
    es = {(rng.randint(1, 24), rng.randint(1, 24)) for _ in range(34)}
    es = {(a, b) for a, b in es if a != b}
    n, e = graph(spark, [(i, str(i), "module", str(i), 1, 2) for i in range(1, 25)], [(a, b, "imports") for a, b in es])
    reach = {i: {i} for i in range(1, 25)}
    for _ in range(24):
        for a, b in es:
            reach[a] |= reach[b]
    want = {i: min(j for j in reach[i] if i in reach[j]) for i in reach if any(j != i and i in reach[j] for j in reach[i])}
    assert {r["id"]: r["cycle"] for r in ga.cyclic_modules(n, e).collect()} == want


def test_communities(spark):
    groups = [range(1, 6), range(6, 11)]
    es = [(a, b, "calls") for g in groups for a in g for b in g if a < b] + [(5, 6, "calls")]
    n, e = graph(spark, [(i, str(i), "function", f"f{i > 5}", 1, 2) for i in range(1, 12)], es)
    c = ga.communities(n, e)
    got = {r["id"]: r["community"] for r in c.collect()}
    assert len({got[i] for i in groups[0]}) == 1 and len({got[i] for i in groups[1]}) == 1
    assert len(set(got.values())) == 3 and got[11] == 11
    assert [tuple(r)[:2] for r in ga.surprise_edges(n, e, c).select("src", "dst").collect()] == [(5, 6)]
    assert ga.community_listing(n, c, 2).count() == 2


def test_a_star_of_two_sides_settles(spark):
    es = [(a, b, "calls") for a in (1, 2, 3) for b in (4, 5, 6)]
    n, e = graph(spark, [(i, str(i), "function", "f", 1, 2) for i in range(1, 7)], es)
    assert len({r["community"] for r in ga.communities(n, e).collect()}) == 1


def test_layers(spark):
    n, e = graph(spark, [(1, "a", "module", "/x/util/a", 1, 2), (2, "b", "module", "/x/api/b", 1, 2), (3, "t", "module", "/x/a_test.rs", 1, 2), (4, "u", "module", "/x/plain", 1, 2)], [(1, 2, "imports"), (3, 1, "imports"), (2, 1, "imports"), (4, 1, "imports")])
    got = sorted((r["from_layer"], r["to_layer"]) for r in ga.layer_violations(n, e).collect())
    assert got == [("test", "util"), ("util", "service")]


def test_churn_over_many_partitions(spark):
    lines, commits = [], {}
    rng = random.Random(2)
    for _ in range(60):
        who = f"u{rng.randint(1, 3)}@x.test"
        lines += [who, ""]
        for _ in range(rng.randint(0, 3)):
            p = f"src/{rng.randint(1, 4)}.rs"
            lines.append(p)
            commits.setdefault(p, []).append(who)
    log = spark.createDataFrame(list(enumerate(lines)), "pos long, line string").repartition(7)
    got = {r["path"]: (r["commits"], r["owner"]) for r in ga.churn(log).collect()}
    assert got == {p: (len(w), min(set(w), key=lambda x: (-w.count(x), x))) for p, w in commits.items()}


def test_enclosing_definition(spark):
    n, _ = graph(spark, [(1, "o", "function", "f", 1, 1000), (2, "i", "method", "f", 500, 600), (3, "m", "module", "f", 1, 2000)], [(1, 2, "calls")])
    p = spark.createDataFrame([(1, "f", 550), (2, "f", 601), (3, "f", 1500), (4, "g", 1)], "point_id int, file_path string, line int")
    assert {r["point_id"]: r["id"] for r in ga.enclosing_definition(p, n).collect()} == {1: 2, 2: 1}


def build(spark, **files):
    lang = {"rs": "rs", "py": "py", "ts": "ts", "java": "java", "c": "c", "go": "go"}
    rows = [(f"/{n.replace('__', '.')}", lang[n.rsplit("__", 1)[1]], t) for n, t in files.items()]
    n, e = gb.build_graph(spark.createDataFrame(rows, "path string, language string, content string"))
    name = {r["id"]: r["name"] for r in n.collect()}
    return {(r["name"], r["kind"]) for r in n.collect()}, {(name[r["src"]], name[r["dst"]], r["kind"]) for r in e.collect()}


def test_graph_of_python(spark):
    n, e = build(spark, a__py="import b\n\n@app.get('/x')\ndef page():\n    helper()\n", b__py="class K:\n    def run(self):\n        helper()\n\ndef helper():\n    pass\n")
    assert {("page", "endpoint"), ("K", "class"), ("run", "method"), ("helper", "function"), ("a", "module")} <= n
    assert {("page", "helper", "calls"), ("run", "helper", "calls"), ("a", "b", "imports"), ("b", "K", "contains")} <= e


def test_graph_of_rust(spark):
    n, e = build(spark, main__rs="mod util;\nfn main() { parse(); Cfg::load(); twice(); }\nfn here() { parse() }\nfn twice() {}\n", util__rs="pub struct Cfg {}\nimpl Cfg { pub fn load() -> u8 { 1 } }\npub fn parse() {}\nenum E { A }\ntrait T { fn q(); }\n")
    assert {("Cfg", "struct"), ("E", "class"), ("T", "trait"), ("main", "function")} <= n
    assert ("main", "util", "imports") in e and ("main", "twice", "calls") in e
    assert not any(d == "parse" and k == "calls" for _, d, k in e)  # a common name in another file


def test_graph_of_others(spark):
    n, e = build(
        spark, app__ts="import { f } from './lib';\nclass V {\n  constructor() {}\n  draw(a) { f(); }\n}\nrouter.get('/users', listUsers);\nfunction listUsers() {}\n", lib__ts="export const f = (x) => { return x; };\n",
        M__java="public class M {\n  @GetMapping(\"/x\")\n  public int page(int a) {\n    return help();\n  }\n  int help() { return 1; }\n}\n", s__go="package s\ntype P struct {\n}\nfunc (p *P) Run() {\n}\nfunc Go() {\n}\n", k__c="struct q {\n int a;\n};\nint add(int a, int b) {\n  return a;\n}\n",
    )
    assert {("V", "class"), ("draw", "method"), ("GET /users", "endpoint"), ("listUsers", "endpoint"), ("f", "function"), ("M", "class"), ("page", "endpoint"), ("P", "struct"), ("Run", "method"), ("Go", "function"), ("q", "struct"), ("add", "function")} <= n
    assert ("app", "lib", "imports") in e and ("draw", "f", "calls") in e


def test_bare(spark):
    assert spark.range(1).select(ga.bare(F.lit("A::b"))).collect()[0][0] == "b"


def test_rising_chain_of_cycles(spark):
    """Cycles whose smallest ids rise along a chain take a round each; none is lost."""
    e = [x for k in range(0, 12, 2) for x in ((k, k + 1), (k + 1, k), (k + 1, k + 2))]
    n = spark.createDataFrame([(i, f"m{i}", "module", f"/f{i}", 1, 2) for i in range(14)], "id int, name string, kind string, file_path string, line_start int, line_end int")
    got = ga.cyclic_modules(n, spark.createDataFrame([(a, b, "imports") for a, b in e], "src int, dst int, kind string"))
    assert sorted(map(tuple, got.collect())) == [(i, i // 2 * 2) for i in range(12)]


def test_members_and_lifted_edges(spark):
    n = spark.createDataFrame([(1, "a", "module", "/a", 1, 9), (2, "f", "function", "/a", 1, 3), (3, "b", "module", "/b", 1, 9), (4, "g", "function", "/b", 1, 3), (5, "h", "function", "/b", 4, 5)], "id int, name string, kind string, file_path string, line_start int, line_end int")
    e = spark.createDataFrame([(2, 4, "calls"), (4, 5, "calls"), (5, 2, "calls")], "src int, dst int, kind string")
    assert sorted(map(tuple, ga.lifted(n, e).select("src", "dst").collect())) == [(1, 3), (3, 1)]
    com = spark.createDataFrame([(i, 1 if i in (2, 4, 5) else i) for i in range(1, 6)], "id int, community long")
    top = ga.community_listing(n, com, 1).collect()[0]
    assert (top["community"], top["size"], top["members"]) == (1, 4, "f, g, h")
    assert ga.filter_edges(e, ("imports",)).count() == 0 and ga.filter_edges(e).count() == 3
