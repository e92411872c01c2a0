"""The call graph: nodes and edges, leaves, levels, cycles, reachability and reports.

Edges are (src, dst) or wider; every loop below works on whole frontiers and cuts its lineage by writing to the shared
checkpoint folder, so a lost executor costs a stage and not the run.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.sources.sinks import kept

#: Rounds after which a loop gives up with an error rather than run on.
MOST_ROUNDS = 10_000

#: Rows of a table of names up to which it is sent to all executors, through the driver.
FEW_NAMES = 50_000


def cut(df: DataFrame) -> DataFrame:
    """Write a frontier to the checkpoint folder; a folder of our own in local mode if none is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        set_dir = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if set_dir is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if set_dir is None:
            import tempfile

            set_dir = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(set_dir)
    return df.checkpoint()


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that is not broadcast: Spark goes by sizes that it carries on from compressed files, and so sends millions of names through the driver."""
    return df.hint("merge")


def looked_up(df: DataFrame) -> DataFrame:
    """A side of a join for keys that many rows may share: broadcast if it has few rows, which are counted, else merged."""
    return F.broadcast(df) if df.count() <= FEW_NAMES else merged(df)


def nodes(edges: DataFrame, procedures: DataFrame | None = None) -> DataFrame:
    """All names that occur, each once, and whether the corpus defines them."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name"))
    if procedures is None:
        return ends.distinct().withColumn("defined", F.lit(True))
    known = procedures.select("name", F.lit(1).alias("d"))
    return ends.select("name", F.lit(0).alias("d")).unionByName(known).groupBy("name").agg((F.max("d") == 1).alias("defined"))


def typed_edges(calls: DataFrame | None, linked: DataFrame | None, dynamic: DataFrame | None, variable: DataFrame | None, tables: DataFrame | None, temps: DataFrame | None, key: str) -> DataFrame:
    """Every relationship as (src, dst, rel, certainty): calls, tables, temporary tables, remote and dynamic uses; those that are None are left out."""
    row = lambda df, dst, rel, certainty=None: df.select(F.col(key).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), F.lit(rel).alias("rel"), F.lit(certainty).cast("string").alias("certainty"))
    kinds = ((calls, "callee", "CALLS", "resolved"), (tables, "table_name", "USES_TABLE"), (temps, "name", "USES_TEMP_TABLE"), (linked, "server", "CALLS_REMOTE"), (dynamic, "tier", "USES_DYNAMIC_SQL"))
    parts = [row(*kind) for kind in kinds if kind[0] is not None]
    if variable is not None:
        hit = variable.withColumn("dst", F.explode_outer(F.when(F.size("resolved_targets") > 0, F.col("resolved_targets"))))
        rel = (
            F.when(F.col("certainty").isin("resolved", "conditional"), "CALLS").when(F.col("certainty") == "dispatch_table", "DYNAMIC_DISPATCH").otherwise("UNRESOLVED_CALL")
        )
        parts.append(hit.select(F.col(key).cast("string").alias("src"), F.coalesce("dst", "condition", "variable").alias("dst"), rel.alias("rel"), "certainty"))
    return reduce(DataFrame.unionByName, parts)


def leaves(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Names without outgoing edges."""
    return names.join(edges.select(F.col("src").alias("name")).distinct(), "name", "left_anti")


def out_degree(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Outgoing edges of every name, parallel ones counted."""
    counts = edges.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("out_degree"))
    return names.join(counts, "name", "left").withColumn("out_degree", F.coalesce("out_degree", F.lit(0)))


def chains(edges: DataFrame) -> DataFrame:
    """name, root and distance of every name with exactly one callee (not itself): the first name along its calls that has none or
    several, and how many calls away it is; root is null if the chain runs into a ring.

    Pointers double: each round joins what a name points to with where that points, so a chain of n calls takes log2 n rounds.
    Rounds are read back from files: what is cut keeps Spark's estimate of its size, and each round would take that to the third power.
    """
    only = edges.groupBy("src").agg(F.min("dst").alias("root"), F.count("*").alias("n")).filter("n = 1 and src <> root")
    points = kept(only.select(F.col("src").alias("name"), "root", F.lit(1).cast("long").alias("distance")), "chains")
    size, reach = points.count(), 1
    while True:
        further = points.select(F.col("name").alias("root"), F.col("root").alias("next"), F.col("distance").alias("more"))
        # Many chains may end in one name, so that each name is looked up once.
        open_ = kept(points.select("root").distinct().join(merged(further), "root"), "chains")
        joined = points.join(looked_up(open_), "root", "left")
        if reach > size or open_.isEmpty():
            return joined.select("name", F.when(F.col("next").isNull(), F.col("root")).alias("root"), "distance")
        points = kept(joined.select("name", F.coalesce("next", "root").alias("root"), (F.col("distance") + F.coalesce("more", F.lit(0))).alias("distance")), "chains")
        reach *= 2


def levels(edges: DataFrame, names: DataFrame) -> DataFrame:
    """name and level: 0 for leaves, else one more than the deepest callee; null on a cycle or above one. names holds all ends of edges.

    Chains of single calls are contracted first. What is left is placed layer by layer, once all that it calls is placed, so rounds
    grow with the most branching names on one path and only with the logarithm of the longest chain.
    """
    calls = cut(edges.select("src", "dst").distinct())
    pointed = cut(chains(calls))
    # An edge to a name on a ring keeps its end, which is never placed.
    ends = pointed.select(F.col("name").alias("dst"), "root", "distance")
    waiting = calls.join(merged(pointed.select(F.col("name").alias("src"))), "src", "left_anti").join(merged(ends), "dst", "left")
    weight = F.when(F.col("root").isNull(), 1).otherwise(F.col("distance") + 1).cast("long")
    waiting = cut(waiting.select("src", F.coalesce("root", "dst").alias("dst"), weight.alias("weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    hubs = cut(names.select("name").join(merged(pointed.select("name")), "name", "left_anti"))
    placed = cut(leaves(waiting.select("src"), merged(hubs)).select("name", F.lit(0).cast("long").alias("level")))
    done, best = placed, waiting.select(F.col("src").alias("name"), F.lit(0).cast("long").alias("level")).limit(0)
    for _ in range(MOST_ROUNDS):
        now = merged(placed.select(F.col("name").alias("dst"), "level"))
        told = waiting.join(now, "dst").select(F.col("src").alias("name"), (F.col("level") + F.col("weight")).alias("level"))
        best = cut(best.unionByName(told).groupBy("name").agg(F.max("level").alias("level")))
        waiting = cut(waiting.join(now, "dst", "left_anti"))
        open_ = merged(waiting.select(F.col("src").alias("name")).distinct())
        placed = cut(best.join(open_, "name", "left_anti"))
        if placed.isEmpty():
            break
        best = best.join(open_, "name", "left_semi")
        done = done.unionByName(placed)
    else:
        raise RuntimeError("the graph is deeper than the most rounds")
    done = cut(done)
    above = pointed.join(looked_up(done.select(F.col("name").alias("root"), "level")), "root", "left").select("name", (F.col("level") + F.col("distance")).alias("level"))
    return hubs.join(merged(done), "name", "left").unionByName(above)


def plan(edges: DataFrame, procedures: DataFrame) -> DataFrame:
    """name, level, external and cyclic of all that is called or calls: null levels stand on a cycle or above one."""
    names = cut(nodes(edges, procedures).select("name", (~F.col("defined")).alias("external")))
    on_cycle = components(edges).select(F.col("name").alias("c_name"))
    # What is on a cycle has no level. It calls itself in place of others, so that no chain runs round a ring for as many rounds as if all names were one.
    calls = edges.join(merged(on_cycle), F.col("src") == F.col("c_name"), "left").select("src", F.when(F.col("c_name").isNull(), F.col("dst")).otherwise(F.col("src")).alias("dst"))
    ordered = levels(calls, names).select(F.col("name").alias("l_name"), "level")
    rows = names.join(merged(ordered), F.col("name") == F.col("l_name")).join(merged(on_cycle), F.col("name") == F.col("c_name"), "left")
    return rows.select("name", "level", "external", F.col("c_name").isNotNull().alias("cyclic"))


def callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """target, caller and distance of everything that reaches a target by calls.

    No side of the joins is broadcast: it would go through the driver in each round.
    """
    back = cut(edges.select(F.col("dst").alias("at"), F.col("src").alias("caller")).distinct())
    front = cut(targets.select(F.col("name").alias("target"), F.col("name").alias("at")).join(merged(back), "at").select("target", "caller").distinct().withColumn("distance", F.lit(1).cast("long")))
    seen = front
    for distance in range(2, MOST_ROUNDS):
        step = front.select("target", F.col("caller").alias("at")).join(merged(back), "at").select("target", "caller").distinct()
        front = cut(step.join(merged(seen), ["target", "caller"], "left_anti").withColumn("distance", F.lit(distance).cast("long")))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))
    raise RuntimeError("the graph is deeper than the most rounds")


def peeled(edges: DataFrame) -> DataFrame:
    """The edges that are left when names without callers or without calls are taken away until none is."""
    size = edges.count()
    for _ in range(MOST_ROUNDS):
        called, calling = (merged(edges.select(F.col(end).alias(other)).distinct()) for end, other in (("dst", "src"), ("src", "dst")))
        edges = cut(edges.join(called, "src", "left_semi").join(calling, "dst", "left_semi"))
        before, size = size, edges.count()
        if size in (0, before):
            return edges
    raise RuntimeError("the graph is deeper than the most rounds")


def components(edges: DataFrame) -> DataFrame:
    """name and component (its smallest name) of everything on a cycle, of whatever length: strongly connected parts and self calls.

    Every name takes the smallest name that reaches it; those that reach that one back, within its color, are its component.
    """
    e = cut(edges.select("src", "dst").distinct())
    found = e.filter("src = dst").select(F.col("src").alias("name"), F.col("src").alias("component"))
    e = peeled(cut(e.filter("src <> dst")))
    for _ in range(MOST_ROUNDS):
        if e.isEmpty():
            break
        colors = cut(e.select(F.col("src").alias("name"), F.col("src").alias("color")).distinct())
        for _ in range(MOST_ROUNDS):
            passed = e.join(merged(colors.withColumnRenamed("name", "src")), "src").select(F.col("dst").alias("name"), "color")
            new = cut(colors.unionByName(passed).groupBy("name").agg(F.min("color").alias("color")))
            same = new.join(merged(colors), ["name", "color"], "left_anti").isEmpty()
            colors = new
            if same:
                break
        else:
            raise RuntimeError("the graph is deeper than the most rounds")
        side = lambda end: merged(colors.select(F.col("name").alias(end), F.col("color").alias(f"{end}_color")))
        inner = cut(e.join(side("src"), "src").join(side("dst"), "dst").filter("src_color = dst_color").select("src", "dst"))
        members = front = cut(colors.filter("name = color"))
        for _ in range(MOST_ROUNDS):
            step = inner.join(merged(front.withColumnRenamed("name", "dst")), "dst").select(F.col("src").alias("name"), "color").distinct()
            front = cut(step.join(merged(members), ["name", "color"], "left_anti"))
            if front.isEmpty():
                break
            members = cut(members.unionByName(front))
        else:
            raise RuntimeError("the graph is deeper than the most rounds")
        many = members.groupBy("color").agg(F.count("*").alias("n")).filter("n > 1").select("color")
        found = found.unionByName(members.join(merged(many), "color", "left_semi").select("name", F.col("color").alias("component")))
        gone = members.select("name")
        away = lambda end: merged(gone.withColumnRenamed("name", end))
        e = peeled(cut(e.join(away("src"), "src", "left_anti").join(away("dst"), "dst", "left_anti")))
    else:
        raise RuntimeError("the graph is deeper than the most rounds")
    # A member that also calls itself belongs to the larger component, whose smallest name is at most its own.
    return cut(found.groupBy("name").agg(F.min("component").alias("component")))


def cycles(edges: DataFrame, longest: int = 10, most: int | None = None) -> DataFrame:
    """Simple cycles, each once, from its smallest name and back to it; in order of path.

    Every component of the graph is reported: all its cycles of at most ``longest`` calls, and if it has none so short,
    a shortest one through its smallest name. A warning says that longer ones may be left out. A path starts at its
    smallest name and takes only larger ones, so no cycle is found twice. ``most`` keeps the first ones only, as a report does.
    """
    parts = components(edges)
    side = lambda end: parts.select(F.col("name").alias(end), F.col("component").alias(f"{end}_part"))
    within = edges.select("src", "dst").distinct().join(side("src"), "src").join(side("dst"), "dst").filter("src_part = dst_part")
    e = cut(within.select("src", "dst"))
    first, last = F.get("path", F.lit(0)), F.element_at("path", -1)
    paths = cut(e.filter("src <= dst").select(F.array("src", "dst").alias("path")))
    found = paths.filter(first == last)
    paths = paths.filter(first != last)
    for _ in range(longest - 1):
        step = cut(longer(paths, e))
        if step.isEmpty():
            break
        found = found.unionByName(step.filter(first == last))
        paths = step.filter(first != last)
    else:
        if not paths.isEmpty():
            warnings.warn(f"cycles of more than {longest} calls are listed only for components without a shorter one", stacklevel=2)
            found = found.unionByName(shortest_cycles(parts, e, found))
    shown = found.select(F.array_join("path", " -> ").alias("cycle"), (F.size("path") - 1).cast("long").alias("length"))
    return shown.orderBy("cycle").limit(most) if most else shown


def longer(paths: DataFrame, e: DataFrame) -> DataFrame:
    """Paths with one more call, back to their start or on to a larger name that they do not hold."""
    first, last = F.get("path", F.lit(0)), F.element_at("path", -1)
    step = paths.join(e, last == F.col("src")).filter((F.col("dst") == first) | ((F.col("dst") > first) & ~F.array_contains("path", F.col("dst"))))
    return step.select(F.array_append("path", F.col("dst")).alias("path"))


def shortest_cycles(parts: DataFrame, e: DataFrame, found: DataFrame) -> DataFrame:
    """One shortest cycle (path) for each component that has none among those found; one path a name is followed."""
    first, last = F.get("path", F.lit(0)), F.element_at("path", -1)
    known = found.select(first.alias("name")).join(parts, "name").select("component").distinct()
    start = parts.select("component").distinct().join(known, "component", "left_anti")
    paths = cut(start.select(F.array("component").alias("path")))
    seen, out = paths.select(first.alias("start"), last.alias("at")), paths.limit(0)
    for _ in range(MOST_ROUNDS):
        step = cut(longer(paths, e).groupBy(first.alias("start"), last.alias("at")).agg(F.min("path").alias("path")))
        out = cut(out.unionByName(step.filter("start = at").select("path")))
        closed = out.select(first.alias("start"))
        step = cut(step.join(seen, ["start", "at"], "left_anti").join(closed, "start", "left_anti"))
        if step.isEmpty():
            return out
        seen, paths = cut(seen.unionByName(step.select("start", "at"))), step.select("path")
    raise RuntimeError("the graph is deeper than the most rounds")


def external(names: DataFrame) -> DataFrame:
    """Names that are called but not defined."""
    return names.filter(~F.col("defined")).select("name")
