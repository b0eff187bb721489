"""Steps that frames of rules share: what is read once, counted in place, or leaves a walk."""

import random
from itertools import combinations

from weftgraph.graph import CodeGraph
from weftgraph.operators import rules, traverse

SYMBOLS = "fq_name string, name string, kind string, file_path string, namespace string, parent_fq_name string, start_line int, end_line int, modifiers array<string>, parameters array<string>, return_type string"
EDGES = "source string, target string, edge_type string, file_path string, line int"


def some_graph(spark, seed=5):
    """Three classes of six methods, an interface, and calls, some of them twice or to names that no symbol has."""
    rng = random.Random(seed)
    row = lambda name, kind, parent: (name, name.split(".")[-1], kind, f"{name[:3]}.py", name[:3], parent, 1, 30, [], [], "")
    owners = ["n.a", "n.b", "m.c"]
    methods = [f"{o}.f{k}" for o in owners for k in range(6)]
    symbols = [row(o, "class", None) for o in owners] + [row("m.i", "interface", None)] + [row(m, "method", m[:3]) for m in methods]
    calls = [(rng.choice(methods + owners), rng.choice([*methods, "m.i", "far.away"]), "calls", "x.py", k % 2) for k in range(70)]
    contains = [(m[:3], m, "contains", "x.py", 0) for m in methods]
    return CodeGraph(spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(calls + contains, EDGES)), methods, calls


def test_counting_makes_no_finding(spark, monkeypatch):
    g, methods, _ = some_graph(spark)
    fails = rules.Rule("X1", "fails", "naming", "info", "symbol", "kind = 'method'", "raise_error('a finding was made')")
    monkeypatch.setitem(rules.RULES, "X1", fails)
    got = rules.findings(g, rules=["X1"], per=("severity",)).collect()
    assert [(r.severity, r.n) for r in got] == [("info", len(methods))]


def test_links_to_what_is_seen_leave_the_walk(spark, monkeypatch):
    left = []

    def watched(df):
        out = kept(df)
        if out.columns == ["a", "b"]:
            left.append(out.count())
        return out

    kept = traverse.checkpointed
    monkeypatch.setattr(traverse, "checkpointed", watched)
    links = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("b", "r"), ("c", "d"), ("c", "a"), ("far", "off")], "a string, b string")
    found = traverse.reachable(links, spark.createDataFrame([("r",)], "node string"))
    assert sorted(r.node for r in found.collect()) == ["a", "b", "c", "d", "r"]
    # r; then a and b; then c; then d
    assert left == [7, 4, 2, 1, 1]


def test_pairs_and_couplings_of_types(spark):
    g, methods, calls = some_graph(spark)
    got = {r.fq_name: r for r in rules.Frames(g, "2025-01-01")("type").collect()}
    targets = {m: {t for s, t, *_ in calls if s == m} for m in methods}
    for owner in ("n.a", "n.b", "m.c"):
        own = [m for m in methods if m[:3] == owner]
        every = set().union(*[targets[m] for m in own]) | {t for s, t, *_ in calls if s == owner}
        parents = {t[:3] for m in own for t in targets[m] if t in methods}
        assert got[owner].sharing_pairs == sum(bool(targets[x] & targets[y]) for x, y in combinations(own, 2))
        assert (got[owner].n_deps, got[owner].n_interface_deps) == (len(every), int("m.i" in every))
        assert (got[owner].cbo, got[owner].delegate_classes) == (len(parents - {owner}), len(parents))
        assert got[owner].single_call_methods == sum(sum(s == m for s, *_ in calls) == 1 for m in own)
        assert got[owner].child_referenced and got[owner].referenced == any(t == owner for _, t, *_ in calls)
