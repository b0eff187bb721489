"""Metrics, traversals and rules on hand-made graphs."""

import pytest

from weftgraph.graph import CodeGraph
from weftgraph.operators import blame, metrics, rules, traverse

COLUMNS = "fq_name string, name string, kind string, file_path string, namespace string, parent_fq_name string, start_line int, end_line int, signature string, modifiers array<string>, parameters array<string>, base_types array<string>, return_type string, doc_comment string, cyclomatic_complexity int, cognitive_complexity int, commit_count int, author_count int, last_author string, last_modified_at timestamp_ntz, structural_fingerprint string"
FIELDS = [c.split(" ")[0] for c in COLUMNS.split(", ")]


def sym(fq, kind="method", ns="", path="a/f.py", parent=None, lines=(1, 10), **more):
    base = dict.fromkeys(FIELDS)
    base |= {"fq_name": fq, "name": fq.rpartition(".")[2], "kind": kind, "namespace": ns, "file_path": path, "parent_fq_name": parent, "start_line": lines[0], "end_line": lines[1], "signature": "", "modifiers": [], "parameters": [], "base_types": [], "return_type": "", "doc_comment": "doc", "cyclomatic_complexity": 1, "cognitive_complexity": 0, "commit_count": 0, "author_count": 0, "last_author": "", "structural_fingerprint": ""}
    return tuple((base | more)[f] for f in FIELDS)


@pytest.fixture(scope="module")
def graph(spark):
    def make(symbols, edges, deps=()):
        e = [(*x, "a/f.py", 0) if len(x) == 3 else x for x in edges]
        return CodeGraph(
            spark.createDataFrame(list(symbols), COLUMNS), spark.createDataFrame(e, "source string, target string, edge_type string, file_path string, line int"),
            spark.createDataFrame(list(deps), "name string, version string, ecosystem string, file_path string, is_dev boolean, is_pinned boolean"),
        )

    return make


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_module_metrics(graph):
    g = graph(
        [sym("a.X", "class", "a"), sym("a.f", ns="a"), sym("b.I", "interface", "b"), sym("b.g", ns="b"), sym("c.h", ns="c")],
        [("a.f", "b.g", "calls"), ("a.X", "a.f", "contains"), ("a.X", "a.f", "calls"), ("a.f", "unknown", "calls")],
    )
    m = {r.module: r for r in metrics.module_metrics(g).collect()}
    assert (m["a"].instability, m["b"].instability, m["c"].instability) == (1.0, 0.0, 0.0)
    assert (m["a"].afferent, m["a"].efferent, m["b"].afferent) == (0, 1, 1)
    assert m["a"].cohesion == round(2 / 3, 6) and m["c"].cohesion == 0.0
    assert m["b"].abstractness == 1.0 and m["b"].distance == 0.0 and m["c"].distance == 1.0
    assert m["a"].depends_on == "b"


def test_fan_counts_names_once(graph):
    g = graph([sym("f"), sym("g"), sym("h")], [("f", "g", "calls"), ("f", "g", "calls"), ("h", "g", "calls"), ("f", "print", "calls")])
    assert rows(metrics.with_fan(g), "fq_name", "fan_in", "fan_out") == [("f", 0, 2), ("g", 2, 0), ("h", 0, 1)]


def test_reachability_and_dead_code(graph):
    g = graph(
        [sym("main", ns="a"), sym("f", ns="a"), sym("g", ns="b"), sym("dead", ns="b"), sym("C.__init__", "constructor", "c"), sym("T", "class", "d"), sym("pub", ns="e", modifiers=["public"])],
        [("main", "f", "calls"), ("f", "g", "calls"), ("g", "main", "calls"), ("dead", "g", "calls"), ("main", "T", "imports"), ("x", "dead", "imports")],
    )
    r = traverse.reached(g)
    assert {x[0] for x in rows(r.filter("is_reached"), "fq_name")} == {"main", "f", "g", "C.__init__", "pub"}
    assert rows(traverse.dead_modules(r), "module") == [("d",)]
    assert rows(traverse.dead_imports(g, r), "source", "target") == [("main", "T"), ("x", "dead")]


def test_hops_and_impact(graph, spark):
    g = graph([sym(x) for x in "abcd"], [("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"), ("z", "d", "calls"), ("a", "z", "calls")])
    seed = spark.createDataFrame([("d",)], "node string")
    assert rows(traverse.impact(g, seed), "distance", "fq_name") == [(1, "c"), (2, "a"), (2, "b")]
    assert rows(traverse.neighborhood(g, seed, 1), "node", "distance") == [("c", 1), ("d", 0), ("z", 1)]
    assert rows(traverse.neighbours(g, seed), "relation", "fq_name") == [("caller", "c")]


def test_inheritance_and_cycles(graph, spark):
    up = [("d", "c"), ("c", "b"), ("b", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("s", "s")]
    g = graph([sym("a", "class")], [(a, b, "inherits") for a, b in up])
    want = {}
    base = dict(up)
    for n in base:
        seen, at, depth = set(), n, 0
        while at in base and at not in seen:
            seen.add(at)
            at, depth = base[at], depth + 1
        want[n] = depth
    assert dict(rows(traverse.inheritance_depth(g), "fq_name", "depth")) == want
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "f"), ("f", "e")], "a string, b string")
    assert rows(traverse.cycles(pairs), "component", "members") == [("a", "a,b,c"), ("e", "e,f")]
    assert rows(metrics.two_cycles(pairs), "a", "b") == [("e", "f")]


def test_entry_points(graph):
    g = graph(
        [sym("UserController", "class", base_types=["ControllerBase"]), sym("UserController.Get", parent="UserController", modifiers=["public"]), sym("UserController.Hide", parent="UserController"), sym("P.Main", modifiers=["static"]), sym("Startup", "class"), sym("W", "class", base_types=["BackgroundService"])],
        [("UserController", "UserController.Get", "contains"), ("UserController", "UserController.Hide", "contains")],
    )
    assert rows(traverse.entry_points(g), "kind", "fq_name", "route") == [
        ("controller", "UserController", "/user"), ("controller_action", "UserController.Get", "/user/Get"), ("main", "P.Main", ""), ("startup", "Startup", ""), ("worker", "W", ""),
    ]


def fired(g, *ids, **config):
    return {(r.rule_id, r.symbol_fq_name) for r in rules.findings(g, config, rules=list(ids) or None, as_of="2025-01-01").collect()}


def test_symbol_rules(graph):
    from datetime import datetime

    g = graph(
        [
            sym("long", lines=(1, 31)), sym("short", lines=(1, 30)), sym("empty", lines=(5, 6)), sym("many", parameters=list("abcdef")), sym("K.__init__", "constructor", parameters=list("abcde")),
            sym("qq"), sym("id"), sym("check", return_type="bool"), sym("isOk", return_type="bool"), sym("strName", "field"), sym("string", "field"), sym("nodoc", doc_comment=""), sym("private", doc_comment="", modifiers=["private"]),
            sym("db_password", "field", return_type="String", modifiers=["public"]), sym("execute_sql"), sym("hot", commit_count=11, cyclomatic_complexity=31, cognitive_complexity=41),
            sym("old", last_modified_at=datetime(2020, 1, 1)), sym("clone1", structural_fingerprint="f"), sym("clone2", structural_fingerprint="f"),
        ],
        [("a", "short", "calls")],
    )
    got = fired(g, "CC001", "CC003", "CC004", "CC005", "NM001", "NM002", "NM004", "DOC001", "SEC001", "SEC002", "SEC003", "CX004", "CX005", "CX006", "CX007", "GB001", "GB002", "GB004", "DUP001", "DUP002", "SM001")
    of = lambda i: {s for r, s in got if r == i}
    assert of("CC001") == {"long"} and of("CC004") == {"empty"} and of("CC003") == {"many"} and of("CC005") == {"K.__init__"}
    assert of("NM001") == {"qq"} and of("NM002") == {"check"} and of("NM004") == {"strName"} and of("DOC001") == {"nodoc"}
    assert of("SEC001") == of("SEC003") == {"db_password"} and of("SEC002") == {"execute_sql"}
    assert of("CX004") == of("CX005") == of("CX006") == of("CX007") == of("GB001") == of("GB004") == {"hot"}
    assert of("GB002") == {"old"} and of("DUP001") == {"clone1", "clone2"} and of("DUP002") == set()
    assert "short" not in of("SM001") and "long" in of("SM001")


def test_type_rules(graph):
    methods = [sym(f"C.m{k}", parent="C", ns="n", modifiers=["static"]) for k in range(4)]
    fields = [sym(f"D.f{k}", "field", parent="D", modifiers=["public"]) for k in range(5)]
    other = [sym(f"O{k}.t", parent=f"O{k}") for k in range(5)]
    edges = [("C", f"C.m{k}", "contains") for k in range(4)] + [("D", f"D.f{k}", "contains") for k in range(5)]
    edges += [("C.m0", "O0.t", "calls")] + [(f"C.m{k}", f"O{k}.t", "calls") for k in range(1, 4)] + [("C", f"I{k}", "implements") for k in range(4)]
    g = graph([sym("C", "class"), sym("D", "struct"), sym("I0", "interface"), sym("Lone", "class"), *methods, *fields, *other], edges)
    got = fired(g, max_fan_out=3, max_children=4)
    assert {"CC006", "CC007", "MT001", "MT002", "AR003", "SOLID004"} <= {r for r, s in got if s == "C"}
    assert {"CC008", "SM003", "CX003"} <= {r for r, s in got if s == "D"}
    assert ("SM006", "I0") in got and ("DS002", "Lone") in got and ("DS002", "C") not in got


def test_envy_surgery_and_middle_man(graph):
    s = [sym("A.m", parent="A"), *[sym(f"B.t{k}", parent="B") for k in range(3)], *[sym(f"K{k}.c", parent=f"K{k}") for k in range(5)], sym("M", "class"), *[sym(f"M.d{k}", parent="M") for k in range(3)]]
    e = [("A.m", f"B.t{k}", "calls") for k in range(3)] + [(f"K{k}.c", "B.t0", "calls") for k in range(5)] + [("M", f"M.d{k}", "contains") for k in range(3)] + [(f"M.d{k}", "B.t1", "calls") for k in range(3)]
    got = fired(graph(s, e), "SM002", "SM004", "SM005")
    assert got == {("SM002", "A.m"), ("SM004", "B.t0"), ("SM005", "M")}


def test_dependency_rules(graph):
    deps = [("flask", "*", "pypi", "a", False, False), ("Flask", ">=1", "pypi", "b", False, False), ("pytest", "==1", "pypi", "a", True, True), ("@x/left-pad", "1.0", "npm", "a", False, True), ("used-lib", "1", "pypi", "a", False, True)]
    g = graph([sym("f", ns="used_lib.core")], [("app", "flask.views", "imports", "app.py", 1), ("app", "pytest", "imports", "app.py", 2), ("t", "pytest", "imports", "tests/t.py", 2)], deps)
    got = fired(g, "DEP001", "DEP002", "DEP003", "DEP004", "DEP005")
    assert got == {("DEP001", "pypi:flask"), ("DEP002", "pypi:Flask"), ("DEP003", "npm:@x/left-pad"), ("DEP004", "pypi:flask"), ("DEP005", "app -> pytest")}


def test_scores(graph):
    g = graph([sym("a", lines=(1, 31)), sym("b"), sym("c"), sym("d")], [("a", "b", "calls")])
    found = rules.findings(g, rules=["CC001"])
    got = dict(rows(rules.scores(found, g.symbols), "scope", "score"))
    assert got["clean_code"] == 75.0 and got["naming"] == 100.0 and got["overall"] == 95.0
    assert rules.findings(g, categories=["clean_code"], disabled=("CC001",)).filter("rule_id = 'CC001'").isEmpty()


def test_there_are_66_rules():
    assert len(rules.RULES) == 66 and {r.category for r in rules.RULES.values()} == set(rules.CATEGORIES)


def test_blame_ties_go_to_the_first_line(spark, graph):
    from datetime import datetime

    g = graph([sym("f", lines=(1, 300)), sym("g", lines=(301, 302))], [("f", "g", "calls")])
    t = datetime(2024, 1, 1)
    lines = [("a/f.py", 2, "ann", t, "c1"), ("a/f.py", 290, "bob", t, "c2"), ("a/f.py", 3, "old", datetime(2020, 1, 1), "c1"), ("other", 2, "x", t, "c9")]
    got = blame.by_symbol(g.symbols, spark.createDataFrame(lines, "file_path string, line_no int, author string, committed_at timestamp_ntz, commit string"))
    assert rows(got, "fq_name", "author_count", "commit_count", "last_author") == [("f", 3, 2, "ann")]


def test_overview_and_pages(graph):
    g = graph([sym("C", "class", "n"), sym("C.a", ns="n", parent="C")], [("C", "C.a", "contains")])
    assert dict(rows(metrics.overview(g), "item", "n")) == {"kind:class": 1, "kind:method": 1, "symbols": 2, "modules": 1, "edges": 1}
    assert rows(metrics.members_page(g, 10), "owner", "fq_name", "row") == [("C", "C.a", 1)]
