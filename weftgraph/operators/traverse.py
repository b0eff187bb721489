"""Traversals as loops of joins: each round joins only the new frontier, and stops when it is empty.

Rounds are bounded by the hops asked for, or end by themselves. A round's nodes are checkpointed and
never written again; what is visited is the union of the rounds. Long chains do not cost a round a step: where a walk
goes on, nodes with one way in are contracted to the node above their chain by pointer doubling, and
the walk continues over what is left. Depths are doubled likewise. No graph is walked in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import FUNCTIONS, TYPES, CodeGraph, checkpointed
from .metrics import has_any, module_of

#: Names that count as roots of reachability, of entry methods, and of bases of controllers and workers.
ROOT_NAMES = ("main", "Main", "run", "start", "execute", "handle", "setup", "configure", "init", "__init__", "__main__", "app", "create_app", "Application")
CONTROLLER_BASES = ("Controller", "ControllerBase", "ApiController", "ODataController")
WORKER_BASES = ("BackgroundService", "IHostedService")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def hops(links: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(node, distance): nodes within `most` steps of seeds (node) over links (a, b). Least distance."""
    links = checkpointed(links.select("a", "b").distinct())
    rounds = [checkpointed(seeds.select("node").distinct().withColumn("distance", F.lit(0)))]
    for step in range(1, most + 1):
        new = links.join(rounds[-1].select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct().join(_union(rounds), "node", "left_anti")
        rounds.append(checkpointed(new.withColumn("distance", F.lit(step))))
        if rounds[-1].isEmpty():
            break
    return _union(rounds)


#: Rounds of a walk before the rest of the graph is contracted.
STEPS = 12


def climbed(up: DataFrame) -> DataFrame:
    """(node, end, steps, final) of links (node, up), one a node: where each chain ends, and after how many steps; not final if it never does.

    Pointer doubling: a round squares the steps known, so rounds are the logarithm of the longest chain. After as many as could
    end any chain, what is not final leads into a cycle, and its end is on it. Hot ends are split by the join.
    """
    up = checkpointed(up.select("node", F.col("up").alias("end")))
    nodes = up.select(F.col("node").alias("end")).withColumn("goes_on", F.lit(True))
    state = checkpointed(up.join(nodes, "end", "left").select("node", "end", F.lit(1).cast("long").alias("steps"), F.col("goes_on").isNull().alias("final")))
    for _ in range(state.count().bit_length() + 1):
        going = state.filter("NOT final")
        if going.isEmpty():
            break
        step = state.select(F.col("node").alias("end"), F.col("end").alias("far"), F.col("steps").alias("more"), F.col("final").alias("last"))
        moved = going.join(step, "end").select("node", F.col("far").alias("end"), (F.col("steps") + F.col("more")).alias("steps"), F.col("last").alias("final"))
        state = checkpointed(state.filter("final").unionByName(moved))
    return state


def circles(up: DataFrame) -> DataFrame:
    """(node, least, size): the cycles that nodes (node, up), one a node, form; all nodes given are on one."""
    state = checkpointed(up.select("node", F.col("up").alias("end"), F.least("node", "up").alias("least")))
    for _ in range(state.count().bit_length()):
        step = state.select(F.col("node").alias("end"), F.col("end").alias("far"), F.col("least").alias("other"))
        state = checkpointed(state.join(step, "end").select("node", F.col("far").alias("end"), F.least("least", "other").alias("least")))
    return state.join(state.groupBy("least").agg(F.count("*").alias("size")), "least").select("node", "least", "size")


def reachable(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): everything reachable from seeds over links (a, b), seeds included.

    Links to what is seen lead to nothing new and go before each round, which so joins only the rest of the graph.
    Every STEPS rounds the part not yet seen is contracted: a node with one way in is reached with the node above
    its chain, so only nodes with several ways in are walked on.
    """
    rounds = [checkpointed(seeds.select("node").filter("node is not null").distinct())]
    links = links.select("a", "b").filter("a is not null and b is not null and a <> b")
    links = checkpointed(links.join(rounds[0].select(F.col("node").alias("b")), "b", "left_anti").select("a", "b").distinct())
    while not rounds[-1].isEmpty():
        if len(rounds) > STEPS:
            return _contracted(links, checkpointed(_union(rounds)), rounds[-1])
        rounds.append(checkpointed(links.join(rounds[-1].select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()))
        links = checkpointed(links.join(rounds[-1].select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"))
    return _union(rounds)


def _contracted(links: DataFrame, seen: DataFrame, frontier: DataFrame) -> DataFrame:
    """What is seen, and all that its frontier leads to over links to what is not seen, by way of a graph without chains."""
    one = links.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"), F.min("a").alias("up")).filter("n = 1")
    # chains that end nowhere are cycles without a way in
    heads = checkpointed(climbed(one.select("node", "up")).filter("final").select("node", F.col("end").alias("head")))
    several = links.join(one.select(F.col("node").alias("b")), "b", "left_anti")
    lifted = several.join(heads.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("head", "a").alias("a"), "b")
    reached_heads = checkpointed(reachable(lifted, frontier))
    below = heads.join(reached_heads.select(F.col("node").alias("head")), "head", "left_semi").select("node")
    return _union([seen, reached_heads, below]).distinct()


def call_links(g: CodeGraph, direction: str = "out") -> DataFrame:
    calls = g.of_type("calls").select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = calls.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return {"out": calls, "in": back}.get(direction) if direction != "both" else calls.unionByName(back)


def neighborhood(g: CodeGraph, seeds: DataFrame, depth: int = 2) -> DataFrame:
    return hops(call_links(g, "both"), seeds, depth)


def impact(g: CodeGraph, changed: DataFrame, most: int = 3, limit: int | None = 50) -> DataFrame:
    """Symbols that call changed ones, directly or not: (fq_name, distance), nearest first. A report of `limit` rows."""
    found = hops(call_links(g, "in"), changed, most).filter("distance > 0").join(g.symbols.select(F.col("fq_name").alias("node")), "node", "left_semi")
    rows = found.select(F.col("node").alias("fq_name"), "distance").orderBy("distance", "fq_name")
    return rows.limit(limit) if limit else rows


def flow(g: CodeGraph, seeds: DataFrame, steps: int = 30, most: int = 10) -> DataFrame:
    """Outbound calls from seeds, by depth and name; a report of `steps` rows."""
    return hops(call_links(g, "out"), seeds, most).select(F.col("node").alias("fq_name"), F.col("distance").alias("depth")).orderBy("depth", "fq_name").limit(steps)


def neighbours(g: CodeGraph, seeds: DataFrame) -> DataFrame:
    """(node, relation, fq_name): known callers, callees and children of each seed, each once."""
    calls, contains = g.of_type("calls"), g.of_type("contains")
    e = (
        calls.select(F.col("target").alias("node"), F.lit("caller").alias("relation"), F.col("source").alias("fq_name"))
        .unionByName(calls.select(F.col("source").alias("node"), F.lit("callee").alias("relation"), F.col("target").alias("fq_name")))
        .unionByName(contains.select(F.col("source").alias("node"), F.lit("child").alias("relation"), F.col("target").alias("fq_name")))
    )
    return e.join(seeds.select("node").distinct(), "node", "left_semi").distinct().join(g.symbols.select("fq_name"), "fq_name", "left_semi").select("node", "relation", "fq_name")


def entry_points(g: CodeGraph) -> DataFrame:
    """(kind, fq_name, route): controllers and their public methods, static Main, Startup and Program, workers."""
    bases = F.coalesce("base_types" if "base_types" in g.symbols.columns else F.lit(None), F.array().cast("array<string>"))
    s = g.symbols.withColumn("bases", bases)
    hit = lambda names: F.arrays_overlap("bases", F.array(*[F.lit(n) for n in names]))
    is_class = F.col("kind") == "class"
    route = F.concat(F.lit("/"), F.lower(F.regexp_replace("name", "Controller$", "")))
    controllers = s.filter(is_class & hit(CONTROLLER_BASES)).select("fq_name", route.alias("route"))
    actions = (
        g.of_type("contains").join(controllers.select(F.col("fq_name").alias("source"), F.col("route").alias("prefix")), "source").select(F.col("target").alias("fq_name"), "prefix")
        .join(g.symbols.filter((F.col("kind") == "method") & has_any("public")), "fq_name")
        .select(F.lit("controller_action").alias("kind"), "fq_name", F.concat("prefix", F.lit("/"), "name").alias("route"))
    )
    row = lambda kind, df: df.select(F.lit(kind).alias("kind"), "fq_name", F.lit("").alias("route"))
    return (
        controllers.select(F.lit("controller").alias("kind"), "fq_name", "route").unionByName(actions)
        .unionByName(row("main", s.filter((F.col("kind") == "method") & (F.col("name") == "Main") & has_any("static"))))
        .unionByName(row("startup", s.filter(is_class & F.col("name").isin("Startup", "Program"))))
        .unionByName(row("worker", s.filter(is_class & hit(WORKER_BASES))))
    )


def roots(g: CodeGraph) -> DataFrame:
    """Where reachability begins: entry points, root names, constructors, top-level exported types, tests, and exported symbols."""
    joined = F.array_join(F.coalesce("modifiers", F.array().cast("array<string>")), ",")
    exported = F.lit(False)
    for word in ("public", "export", "api"):
        exported = exported | joined.contains(word)
    chosen = g.symbols.filter(
        F.col("name").isin(*ROOT_NAMES) | (F.col("kind") == "constructor") | F.col("name").startswith("test") | F.col("name").startswith("Test") | exported
        | (F.col("kind").isin(*TYPES, "interface") & F.col("parent_fq_name").isNull() & has_any("public", "export"))
    )
    return chosen.select(F.col("fq_name").alias("node")).unionByName(entry_points(g).select(F.col("fq_name").alias("node"))).distinct()


def reached_names(g: CodeGraph) -> DataFrame:
    """(node): where any edge but an import leads from a root, over known symbols."""
    known = g.symbols.select(F.col("fq_name").alias("b"))
    links = g.edges.filter("edge_type <> 'imports'").select(F.col("source").alias("a"), F.col("target").alias("b")).join(known, "b", "left_semi")
    return reachable(links, roots(g))


def reached(g: CodeGraph, names: DataFrame | None = None) -> DataFrame:
    """Symbols with `is_reached`: whether they are among the names that are reached (or those given)."""
    found = (reached_names(g) if names is None else names).select(F.col("node").alias("fq_name"), F.lit(True).alias("is_reached"))
    return g.symbols.join(found, "fq_name", "left").withColumn("is_reached", F.coalesce("is_reached", F.lit(False)))


def dead_modules(r: DataFrame) -> DataFrame:
    """Modules none of whose symbols is reached: (module, symbols, files)."""
    m = r.select(module_of().alias("module"), "is_reached", "file_path").filter("module <> ''")
    return m.groupBy("module").agg(F.count("*").alias("symbols"), F.count_distinct("file_path").alias("files"), F.count_if("is_reached").alias("n_reached")).filter("n_reached = 0").drop("n_reached")


def dead_imports(g: CodeGraph, r: DataFrame) -> DataFrame:
    """Imports of a known symbol that is not reached."""
    return g.of_type("imports").select("source", "target", "file_path").distinct().join(r.filter("not is_reached").select(F.col("fq_name").alias("target")), "target", "left_semi")


def inheritance_depth(g: CodeGraph) -> DataFrame:
    """(fq_name, depth) of names with a base: steps up until there is no base, or one repeats.

    Of several bases the last by name counts. A chain that enters a cycle is as deep as the distinct names on it: its
    steps to the cycle, and the cycle's size. All by doubling.
    """
    up = checkpointed(g.of_type("inherits").filter("source IS NOT NULL AND target IS NOT NULL").groupBy(F.col("source").alias("node")).agg(F.max("target").alias("up")))
    state = climbed(up)
    ends = state.filter("final").select("node", "steps")
    endless = state.filter("NOT final")
    if not endless.isEmpty():
        # so many steps on, every chain is on its cycle, and every node of a cycle is some chain's end
        on = checkpointed(endless.select(F.col("end").alias("node")).distinct())
        ring = checkpointed(circles(up.join(on, "node", "left_semi")))
        tails = climbed(up.join(endless.select("node"), "node", "left_semi").join(on, "node", "left_anti"))
        entered = tails.join(ring.select(F.col("node").alias("end"), "size"), "end").select("node", (F.col("steps") + F.col("size")).alias("steps"))
        ends = _union([ends, entered, ring.select("node", F.col("size").alias("steps"))])
    return ends.select(F.col("node").alias("fq_name"), F.col("steps").cast("int").alias("depth"))


def _spread(links: DataFrame, labels: DataFrame, inside: bool) -> DataFrame:
    """labels (node, label) lowered along links (a, b) until nothing changes; `inside`: labels reach only nodes with `own` equal to them."""
    while True:
        moved = links.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("new"))
        better = F.col("new").isNotNull() & (F.col("label").isNull() if inside else F.col("new") < F.col("label"))
        next_ = checkpointed(labels.join(moved, "node", "left").withColumn("changed", better).withColumn("label", F.when(better, F.col("new")).otherwise(F.col("label"))).drop("new"))
        labels = next_.drop("changed")
        if next_.filter("changed").isEmpty():
            return labels


#: Rounds of trimming before chains are contracted.
TRIMS = 3


def _trimmed(links: DataFrame) -> DataFrame:
    """links without those that no cycle can hold: from nodes without a way in, or to nodes without a way out. At most TRIMS rounds."""
    n = links.count()
    for _ in range(TRIMS):
        ins, outs = links.select(F.col("b").alias("a")).distinct(), links.select(F.col("a").alias("b")).distinct()
        links = checkpointed(links.join(ins, "a", "left_semi").join(outs, "b", "left_semi").select("a", "b"))
        before, n = n, links.count()
        if n == before:
            break
    return links


def _coloured(links: DataFrame) -> DataFrame:
    """(component, node) of one round of forward-backward colouring.

    A node's colour is the least node that leads to it; what leads back to the colour's node within
    the colour is its component, perhaps of one node.
    """
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    colour = _spread(links, checkpointed(nodes.withColumn("label", F.col("node"))), False)
    for end in ("a", "b"):
        links = links.join(colour.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")), end)
    back = checkpointed(links.filter("of_a = of_b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = checkpointed(colour.select("node", F.when(F.col("node") == F.col("label"), F.col("node")).alias("label")))
    return checkpointed(_spread(back, own, True).filter("label is not null").select(F.col("label").alias("component"), "node"))


def cycles(pairs: DataFrame) -> DataFrame:
    """(component, size, members): strongly connected components of more than one node, named by the smallest member.

    Links that no cycle can hold are trimmed; nodes with one way in and one way out are contracted, chain by chain and by
    pointer doubling, to a link from the node before them to the one after: they are in a component exactly if both its ends
    are in the same. What cannot be contracted is coloured, and found components go. Then chains are put back, last ones first.
    """
    links = checkpointed(pairs.select("a", "b").filter("a <> b").distinct())
    found, chains = [], []
    while True:
        links = _trimmed(links)
        if links.isEmpty():
            break
        down = links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"), F.min("b").alias("down")).filter("n = 1")
        up = links.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("m"), F.min("a").alias("up")).filter("m = 1")
        through = checkpointed(down.join(up, "node").select("node", "up", "down"))
        if through.isEmpty():
            component = _coloured(links)
            found.append(component)
            for end in ("a", "b"):
                links = links.join(component.select(F.col("node").alias(end)), end, "left_anti")
            links = checkpointed(links.select("a", "b"))
            continue
        first = climbed(through.select("node", "up"))
        alone = checkpointed(through.join(first.filter("NOT final").select("node"), "node", "left_semi"))
        found.append(checkpointed(circles(alone.select("node", "up")).select(F.col("least").alias("component"), "node")))
        last = climbed(through.join(alone.select("node"), "node", "left_anti").select("node", F.col("down").alias("up")))
        chain = checkpointed(first.filter("final").select("node", F.col("end").alias("first")).join(last.select("node", F.col("end").alias("last")), "node"))
        chains.append(chain)
        for end in ("a", "b"):
            links = links.join(through.select(F.col("node").alias(end)), end, "left_anti")
        links = checkpointed(links.select("a", "b").unionByName(chain.select(F.col("first").alias("a"), F.col("last").alias("b")).filter("a <> b")).distinct())
    known = checkpointed(_union(found)) if found else links.select(F.col("a").alias("component"), F.col("b").alias("node"))
    for chain in reversed(chains):
        of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))  # noqa: B023, E731
        ends = chain.join(of("first"), "first", "left").join(of("last"), "last", "left")
        # a chain back to its own start is a cycle, whether or not its start is on another
        held = ends.filter("first = last OR of_first = of_last").select(F.coalesce("of_first", "first").alias("component"), "node", "first")
        starts = held.select("component", F.col("first").alias("node"))
        known = checkpointed(_union([known, held.select("component", "node"), starts]).distinct())
    rows = known.groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members")).filter("size > 1")
    return rows.select(F.element_at("members", 1).alias("component"), "size", F.array_join("members", ",").alias("members"))


def dead_code_summary(r: DataFrame) -> DataFrame:
    return r.agg(
        F.count("*").alias("symbols"), F.count_if("is_reached").alias("n_reached"), F.count_if(~F.col("is_reached") & F.col("kind").isin(*FUNCTIONS)).alias("dead_functions"),
        F.count_if(~F.col("is_reached") & F.col("kind").isin("class", "struct", "interface", "enum")).alias("dead_types"),
    )
