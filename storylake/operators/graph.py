"""Dependency graphs as edges ``src, dst`` (``src`` depends on ``dst``)."""

from __future__ import annotations

from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from storylake.sources.shared import Rounds, settled

#: Nodes with so many dependencies at most are looked through for some that others bring along; it only saves rounds.
REDUCED = 16
#: Pairs of a closure that a task makes distinct, by an upper bound.
DEALT = 2_000_000
#: Cycles that a task hands on at a time.
WALKED = 1_000


def closure(edges: DataFrame) -> DataFrame:
    """All pairs ``src, dst`` joined by a path; on a cycle a node reaches itself.

    Dependencies that two others replace go first. What ``jump`` joins are steps
    of exactly so many edges as the ways found so far have at most, so ways
    double in length each round and a tree's pairs are made once; rounds grow
    with the logarithm of the longest path. A round's pairs are dealt out by
    how many there may be, ``DEALT`` to a task.
    """
    spark = edges.sparkSession
    rounds, jumps = Rounds(spark, "closure"), Rounds(spark, "jumps")
    start = _spared(settled(edges.select("src", "dst").distinct(), "edges"))
    now, jump = rounds.settled(start), jumps.settled(start)
    size, least = now.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        tasks = max(least, 2 * size // DEALT)
        step = jump.select("src", F.col("dst").alias("via")).join(now.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
        now = rounds.settled(now.union(step).repartition(tasks, "src", "dst").distinct())
        before, size = size, now.count()
        if size == before:
            return now
        further = jump.select("src", F.col("dst").alias("via")).join(jump.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
        jump = jumps.settled(further.repartition(tasks, "src", "dst").distinct())


def _spared(edges: DataFrame) -> DataFrame:
    """``edges`` without those that two others replace, neither of which could be replaced itself.

    What reaches what stays as it is, with cycles too. Nodes with more than
    ``REDUCED`` dependencies aren't looked through.
    """
    listed = edges.groupBy(F.col("src").alias("via")).agg(F.collect_list("dst").alias("to")).where(F.size("to") <= REDUCED)
    steps = lambda e, on: e.join(on, e["dst"] == on["via"]).select("src", "via", F.explode("to").alias("dst")).where("src <> via AND via <> dst")
    maybe = settled(edges.join(steps(edges, listed).select("src", "dst").distinct(), ["src", "dst"], "left_semi"), "maybe")
    sure = edges.join(maybe, ["src", "dst"], "left_anti")
    kept = sure.groupBy(F.col("src").alias("via")).agg(F.collect_list("dst").alias("to"))
    gone = steps(sure, kept.where(F.size("to") <= REDUCED)).select("src", "dst").distinct()
    return settled(edges.join(gone, ["src", "dst"], "left_anti"), "spared")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, level``: nodes whose dependencies are all on lower levels; nodes on or behind a cycle are left out.

    Dependencies outside the node set are ignored. Those that two others replace
    are dropped first (they never are the longest way), which makes chains of
    ladders. In a round every dependency whose level is known is folded into its
    node, and one that has a single dependency left is jumped over with the
    length of both, so a run of such nodes halves: a chain of ten thousand takes
    fourteen rounds, a mesh a round a level at worst. Every dependency holds the
    least node on its way; where a jump's both parts hold the same, that node is
    passed twice, so a ring of n is told in a round more than n has binary digits.
    A jump to an open node that is as long as there are open nodes, all of which
    it could have passed, tells of a cycle too. Equal dependencies of a node
    become one as they are grouped: a node with very many is compared with nothing.
    """
    own = settled(nodes.select("node").distinct(), "nodes")
    inside = edges.select("src", "dst").distinct().join(own.select(F.col("node").alias("src")), "src", "left_semi").join(own.select(F.col("node").alias("dst")), "dst", "left_semi")
    inside, most = _spared(settled(inside, "edges")), own.count()
    listed = inside.groupBy(F.col("src").alias("node")).agg(F.collect_list(F.struct("dst", F.lit(1).cast("long").alias("w"), F.col("dst").alias("least"))).alias("deps"))
    empty = F.array().cast(listed.schema["deps"].dataType)
    rounds, before = Rounds(nodes.sparkSession, "levels"), None
    state = rounds.settled(own.join(listed, "node", "left").select("node", F.lit(0).cast("long").alias("base"), F.coalesce("deps", empty).alias("deps"), F.lit(False).alias("stuck")))
    while True:
        told = state.select(F.col("node").alias("dst"), "base", F.when((F.size("deps") == 1) & ~F.col("stuck"), F.col("deps")[0]).alias("only"), ((F.size("deps") == 0) & ~F.col("stuck")).alias("known"), "stuck")
        open_ = state.where("NOT stuck").select("node", F.explode("deps").alias("d")).select("node", "d.dst", "d.w", "d.least").join(told, "dst")
        jumps = F.col("only").isNotNull()
        folded = open_.select(
            "node",
            F.when(F.col("known") | jumps, F.col("w") + F.col("base")).alias("more"),
            F.when(~F.col("known"), F.when(jumps, F.col("only.dst")).otherwise(F.col("dst"))).alias("to"),
            F.when(jumps, F.col("w") + F.col("only.w")).otherwise(F.col("w")).alias("w"),
            F.when(jumps, F.least("least", "only.least")).otherwise(F.col("least")).alias("least"),
            (F.col("stuck") | ~F.col("known") & (F.col("w") > most) | F.coalesce(F.col("least") == F.col("only.least"), F.lit(False))).alias("stuck"),
        )
        kept = folded.groupBy("node", "to").agg(F.max("more").alias("more"), F.max("w").alias("w"), F.min("least").alias("least"), F.bool_or("stuck").alias("held"))
        dep = F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("dst"), "w", "least"))
        kept = kept.groupBy("node").agg(F.max("more").alias("more"), F.collect_list(dep).alias("left"), F.bool_or("held").alias("held"))
        held = F.col("stuck") | F.coalesce("held", F.lit(False))
        state = rounds.settled(state.join(kept, "node", "left").select("node", F.greatest("base", "more").alias("base"), F.when(held, empty).otherwise(F.coalesce("left", empty)).alias("deps"), held.alias("stuck")))
        now = state.agg(F.sum(F.size("deps")), F.sum(F.aggregate("deps.w", F.lit(0).cast("long"), lambda a, x: a + x)), F.count_if("stuck"), F.count_if(F.size("deps") > 0)).first()
        if not now[0] or now == before:
            return state.where("NOT stuck AND size(deps) = 0").select("node", F.col("base").cast("int").alias("level"))
        before, most = now, now[3]


def _spread(start: DataFrame, edges: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """``node, label``: the least label that reaches a node along ``edges``, of those that ``start`` gives; within equal ``color`` if asked.

    A round an edge of the longest of the shortest ways.
    """
    rounds, now, before = Rounds(start.sparkSession, "spread"), start, None
    while True:
        step = edges.join(now.select(F.col("node").alias("src"), "label"), "src").select(F.col("dst").alias("node"), "label")
        if within is not None:
            step = step.join(within.select("node", F.col("label").alias("own")), "node").where("label = own").select("node", "label")
        now = rounds.settled(now.unionByName(step).groupBy("node").agg(F.min("label").alias("label")))
        told = now.agg(F.count("*"), F.sum(F.xxhash64("node", "label") % 1_000_003)).first()
        if told == before:
            return now
        before = told


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component``: nodes on cycles, with the least node of those they reach and are reached from.

    Nodes on no cycle go first, by levels in both directions. In what is left
    the least node that reaches a node colours it; those of a colour that reach
    its own node are its component. They leave, and the rest goes on.
    """
    both = lambda e: e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    turned = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    rest, done = settled(edges.select("src", "dst").distinct(), "edges"), None
    inner = lambda e, gone: settled(e.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti"), "rest")
    for turn in (turned, lambda e: e):  # first those that no cycle needs: what needs a cycle is often all the rest
        rest = inner(rest, levels(both(rest), turn(rest)))
    while True:
        if rest.isEmpty():
            return done if done is not None else both(rest).select("node", F.col("node").alias("component"))
        colors = _spread(both(rest).select("node", F.col("node").alias("label")), rest)
        found = settled(_spread(colors.where("node = label"), turned(rest), colors).select("node", F.col("label").alias("component")), "components")
        looped = rest.where("src = dst").select(F.col("src").alias("node"))
        large = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        real = found.join(large, "component", "left_semi").unionByName(found.join(looped, "node", "left_semi").join(large, "component", "left_anti"), allowMissingColumns=False).select("node", "component")
        done = real if done is None else done.unionByName(real)
        rest = inner(rest, found)


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves."""
    return strong_components(edges).select("node")


def cycle_paths(edges: DataFrame) -> DataFrame:
    """``component, n, path``: a cycle for every edge back to the way that a depth-first walk has come, its first node again at the end.

    Each component is walked from its least node, to lesser nodes first, and
    every node once, so ``n`` numbers the cycles in the order in which they are
    met. A component's own edges are held by one task; all that is on no cycle has left
    before.
    """
    of = strong_components(edges)
    own = edges.select("src", "dst").distinct().join(of.withColumnRenamed("node", "src"), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("__to")), "dst").where("component = __to").select("component", "src", "dst")
    kind = own.schema["src"].dataType.simpleString()
    shape = f"component {kind}, n long, path array<{kind}>"
    types = to_arrow_schema(own.sparkSession.createDataFrame([], shape).schema)

    def walk(first, edges):
        ahead = {}
        for _, src, dst in edges:
            ahead.setdefault(src, []).append(dst)
        met, way, place, left, found = {first}, [first], {first: 0}, [iter(ahead[first])], []
        while left:
            node = next(left[-1], None)
            if node is None:
                left.pop()
                del place[way.pop()]
            elif node in place:
                found.append([*way[place[node] :], node])
            elif node not in met:
                met.add(node)
                place[node] = len(way)
                way.append(node)
                left.append(iter(ahead[node]))
        return [{"component": first, "n": n, "path": path} for n, path in enumerate(found)]

    def run(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        found = (path for first, edges in groupby(rows, itemgetter(0)) for path in walk(first, edges))
        while some := list(islice(found, WALKED)):
            yield pa.RecordBatch.from_pylist(some, schema=types)

    # Components follow each other in their order: thousands of small ones go through one call.
    return own.repartition("component").sortWithinPartitions("component", "src", "dst").mapInArrow(run, shape)


def redundant(edges: DataFrame) -> DataFrame:
    """Direct dependencies that another direct dependency reaches: ``src, dst, through``.

    Whether ``through`` reaches ``dst`` is asked for pairs of direct dependencies
    only, each once. The search goes from ``through`` over nodes whose level
    isn't below that of ``dst``, so it stays between the two; nodes on or behind
    a cycle have no level and are never passed over.
    """
    direct = settled(edges.select("src", "dst").distinct(), "direct")
    nodes = direct.select(F.col("src").alias("node")).union(direct.select("dst")).distinct()
    level = settled(levels(nodes, direct), "level")
    pairs = direct.join(direct.select("src", F.col("dst").alias("through")), "src").where("dst <> through")
    at = lambda c, n: level.select(F.col("node").alias(c), F.col("level").alias(n))
    asked = pairs.select("through", "dst").distinct().join(at("through", "high"), "through", "left").join(at("dst", "low"), "dst", "left").where("high IS NULL OR low < high")
    front = settled(asked.select("through", "dst", "low", F.col("through").alias("node")), "front")
    met, reached = front.select("through", "dst", "node"), None
    step_to = settled(direct.join(at("dst", "level"), "dst", "left").select(F.col("src").alias("node"), F.col("dst").alias("to"), "level"), "steps")
    while not front.isEmpty():
        step = front.join(step_to, "node").where("to = dst OR level IS NULL OR low IS NULL OR level > low")
        step = settled(step.select("through", "dst", "low", F.col("to").alias("node")).distinct(), "step")
        hit = step.where("node = dst").select("through", "dst")
        reached = hit if reached is None else reached.unionByName(hit)
        front = settled(step.join(reached, ["through", "dst"], "left_anti").join(met, ["through", "dst", "node"], "left_anti"), "front")
        met = met.unionByName(front.select("through", "dst", "node"))
    if reached is None:
        return pairs.select("src", "dst", "through").limit(0)
    return pairs.join(reached.distinct(), ["through", "dst"]).select("src", "dst", "through")


def parallel_groups(leveled: DataFrame) -> DataFrame:
    """``level, node`` of the levels that hold more than one node."""
    crowded = leveled.groupBy("level").agg(F.count("*").alias("n")).where("n > 1").select("level")
    return leveled.join(crowded, "level", "left_semi").select("level", "node")
