"""Parent-child rows to full hierarchies: paths, depths, roots, descendants and cycles.

Nodes whose id hashes to zero modulo SPACING are splitters, and so is every root. Every node walks to its next splitter;
the splitters and the walks between them form a reduced pointer graph of about 1/SPACING of the size, which is solved in
the same way with roots alone as stops; exact paths are then expanded by joining a node's walk to the path of the
splitter it ended at. Walks proceed by pointer doubling, so a chain of length n between stops takes log2(n) joins. Nodes
whose walk never ends lie on, or run into, a cycle without a stop; they are solved apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.latest import latest_by
from docketry.session import drop_materialized, materialize

#: One node in so many is a splitter.
SPACING = 8
#: Nodes of a reduced graph, or of loops, up to which one task follows them.
ONE_TASK = 200_000


def node_id(col: Column) -> Column:
    """An id as it is compared: without blanks around it, lower case; null if nothing is left."""
    trimmed = F.lower(F.regexp_replace(col, r"^[\s ]+|[\s ]+$", ""))
    return F.when(F.length(trimmed) > 0, trimmed)


def parent_links(rows: DataFrame, id_col: str, parent_col: str, order_col: str) -> DataFrame:
    """(id, parent) of every registered node.

    Of several rows of a node the one with the largest order_col holds, ties by parent. A null, blank or unregistered
    parent makes a root (parent null). Rows with a null or blank id are no nodes; extra columns are ignored."""
    held = latest_by(rows, node_id(F.col(id_col)), [F.col(order_col)], {"parent": node_id(F.col(parent_col))})
    held = held.withColumnRenamed("_key", "id")
    held = materialize(held, "nodes")
    known = held.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    # rows that name no parent meet nothing, so that they are not one key of the join
    named = held.filter("parent is not null").join(known, "parent", "left").select("id", F.when(F.col("_known"), F.col("parent")).alias("parent"))
    return named.unionByName(held.filter("parent is null").select("id", "parent"))


def _walk(steps: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Pointer doubling until every node that can reach a stop has.

    steps: (id, to, seg, low, stop): one step from id to `to` (null at a root), seg the ids passed, id first, low their
    smallest, stop whether the step ends at a stop. Gives the ended walks and those that never end, in the same form.
    A node at distance d from its stop has nodes at every smaller distance before it, so a round that ends no walk
    proves that none of the rest ever will. Walks that come back to their start lose their seg, so that it stays short."""
    now, left = materialize(steps, name), None
    while True:
        n = now.filter(~F.col("stop")).count()
        if n == 0 or n == left:
            return now.filter("stop"), now.filter(~F.col("stop"))
        left = n
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("seg").alias("_seg"), F.col("low").alias("_low"), F.col("stop").alias("_stop"))
        going = now.filter(~F.col("stop")).join(ahead, "to")
        moved = going.select("id", F.col("_to").alias("to"), F.when(~F.array_contains("_seg", F.col("id")), F.concat("seg", "_seg")).alias("seg"), F.least("low", "_low").alias("low"), F.col("_stop").alias("stop"))
        longer = materialize(now.filter("stop").unionByName(moved), name)
        drop_materialized(now)
        now = longer


def _cycles(loose: DataFrame, name: str) -> DataFrame:
    """(id, cycle_id, on_cycle) of nodes that reach no stop; loose: (id, to, low), closed under `to`.

    Walks are doubled. Far ends become fewer until they are the nodes of cycles alone, and from then on stay as many; lows
    fall until each walk from a cycle has gone all round. When a round changes neither, both are done, so rounds are as
    many as doublings of the longest tail or cycle."""
    now, before = materialize(loose.select("id", "to", "low"), name), None
    while True:
        state = tuple(now.agg(F.count_distinct("to"), F.sum(F.xxhash64("id", "low").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        longer = materialize(now.join(ahead, "to").select("id", F.col("_to").alias("to"), F.least("low", "_low").alias("low")), name)
        drop_materialized(now)
        now = longer
    # low at the far end, which is on the cycle, is the smallest of the whole cycle
    ends = now.select(F.col("id").alias("to"), F.col("low").alias("cycle_id"))
    on = now.select(F.col("to").alias("id")).distinct().withColumn("on_cycle", F.lit(True))
    return now.join(ends, "to").join(on, "id", "left").select("id", "cycle_id", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def _chased(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_walk() and _cycles() of all steps of a task, which are ONE_TASK at most, each node followed once."""
    rows = [r for b in batches for r in b.to_pylist()]
    step = {r["id"]: r for r in rows}
    ended: dict[str, tuple] = {}
    looped: dict[str, tuple] = {}
    for first in step:
        trail, at, here = [], first, {}
        while at not in ended and at not in looped and at not in here and not step[at]["stop"]:
            here[at] = len(trail)
            trail.append(at)
            at = step[at]["to"]
        if at in here:
            ring = trail[here[at] :]
            least = min(step[x]["low"] for x in ring)
            looped |= {x: (least, True) for x in ring}
            trail = trail[: here[at]]
        elif at not in ended and at not in looped:
            ended[at] = (step[at]["to"], step[at]["seg"])
        for x in reversed(trail):
            to = step[x]["to"]
            if to in looped:
                looped[x] = (looped[to][0], False)
            else:
                ended[x] = (ended[to][0], step[x]["seg"] + ended[to][1])
    out = [{"id": x, "to": e[0], "seg": e[1], "cycle_id": None, "on_cycle": None} for x, e in ended.items()] + [{"id": x, "to": None, "seg": [], "cycle_id": c[0], "on_cycle": c[1]} for x, c in looped.items()]
    for i in range(0, len(out), 10_000):
        yield pa.RecordBatch.from_pylist(out[i : i + 10_000], schema=pa.schema([("id", pa.string()), ("to", pa.string()), ("seg", pa.list_(pa.string())), ("cycle_id", pa.string()), ("on_cycle", pa.bool_())]))


def _followed(steps: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(id, to, seg) of steps whose walks end, and (id, cycle_id, on_cycle) of those that don't: in one task if there are few
    steps, else by doubling, with the same answer."""
    steps = materialize(steps.select("id", "to", "seg", "low", "stop"), name)
    if steps.count() <= ONE_TASK:
        done = materialize(steps.coalesce(1).mapInArrow(_chased, "id string, to string, seg array<string>, cycle_id string, on_cycle boolean"), name)
        return done.filter("cycle_id is null").select("id", "to", "seg"), done.filter("cycle_id is not null").select("id", "cycle_id", "on_cycle")
    ended, loose = _walk(steps, name)
    first = loose.select("id").join(steps.select("id", "to", "low"), "id")
    return ended.select("id", "to", "seg"), materialize(_cycles(first, name), name)


@dataclass(frozen=True)
class _Solved:
    """links; ended: every node's walk to its next splitter or its root; reduced: the splitters' walks among them, solved as
    far as a root; bad: (id, cycle_id, on_cycle) of the nodes without a root."""

    links: DataFrame
    ended: DataFrame
    solved: DataFrame
    bad: DataFrame


def _solve(links: DataFrame, spacing: int, paths: bool) -> _Solved:
    """paths: whether walks keep the ids they pass, which nothing but paths, counts and on_cycle need."""
    links = materialize(links.select("id", "parent"), "links")
    with_parent = links.filter("parent is not null")
    roots = links.filter("parent is null").select(F.col("id").alias("parent"), F.lit(True).alias("_root"))
    hashed = F.pmod(F.xxhash64("parent", F.lit(17)), F.lit(spacing)) == 0
    passed = F.array("id") if paths else F.array().cast("array<string>")
    step = lambda stop: ("id", F.col("parent").alias("to"), passed.alias("seg"), F.col("id").alias("low"), stop.alias("stop"))
    steps = with_parent.join(roots, "parent", "left").select(*step(hashed | F.coalesce("_root", F.lit(False))))
    # a root's own step ends at once, at no node
    ended, bare = _walk(steps.unionByName(links.filter("parent is null").select(*step(F.lit(True)))), "walk")

    first_steps = bare.select("id").join(links, "id").select("id", F.col("parent").alias("to"), F.array().cast("array<string>").alias("seg"), F.col("id").alias("low"), F.lit(False).alias("stop"))
    _, of_bare = _followed(first_steps, "bare")

    # the reduced graph: splitters that walks ended at, with their own walks, or the root's empty one
    splitters = ended.filter(F.col("to").isNotNull()).select(F.col("to").alias("id")).distinct()
    to_bare = of_bare.select(F.col("id").alias("to"), F.lit(True).alias("_bare"))
    own = ended.join(splitters, "id")
    on = own.filter("to is not null").join(to_bare, "to", "left").select("id", "to", "seg", "low", F.coalesce("_bare", F.lit(False)).alias("stop"))
    reduced = on.unionByName(own.filter("to is null").select("id", "to", "seg", "low", F.lit(True).alias("stop")))
    if paths:
        # the splitters alone: what lies between them is put in again where a path is asked for
        reduced = reduced.withColumn("seg", F.array("id"))
    solved, of_splitters = _followed(reduced, "reduced")

    # Cycles with splitters come from the reduced graph, those without from the walks that never end. A splitter may
    # also lead to a splitterless cycle. All walks that end at a splitter share its cycle. Lows are those of whole walks.
    ring = own.join(of_splitters.filter("on_cycle").select("id"), "id").select(F.explode("seg").alias("id"), F.lit(True).alias("_on"))
    via = solved.filter(F.col("to").isNotNull()).join(of_bare.select(F.col("id").alias("to"), "cycle_id"), "to").select("id", "cycle_id")
    caught = via.unionByName(of_splitters.select("id", "cycle_id")).unionByName(of_bare.select("id", "cycle_id"))
    tails = ended.filter("to is not null").join(caught.withColumnRenamed("id", "to"), "to").select("id", "cycle_id").join(ring, "id", "left")
    bad = tails.select("id", "cycle_id", F.coalesce("_on", F.lit(False)).alias("on_cycle")).unionByName(of_bare)
    return _Solved(links, ended, solved, bad)


def cycles(links: DataFrame, spacing: int = SPACING) -> DataFrame:
    """(id, cycle_id) of the nodes of (id, parent) that have no root: see hierarchy(). No path is made for it."""
    return _solve(links, spacing, False).bad.select("id", "cycle_id")


def hierarchy(links: DataFrame, spacing: int = SPACING, counts: bool = False) -> DataFrame:
    """(id, parent) to (id, parent, root, depth, path, cycle_id, on_cycle), with counts also n_descendants.

    path is the array of ids from the root to the node, depth its length less one. A node that lies on a loop or whose
    parents run into one has null root, depth and path, and the smallest id of that loop as cycle_id; others have a null
    cycle_id. n_descendants is the number of all nodes beneath, null on or into a cycle. parent must be null or an id; ids
    must be unique (see parent_links). An empty table gives an empty one."""
    done = _solve(links, spacing, True)
    ended, top = done.ended, F.reverse("seg")
    rooted = materialize(done.solved.filter(F.col("to").isNull()).select("id", "seg"), "splitters")
    # the splitters above a splitter, each with the walk that leads up from it
    above = rooted.select("id", F.posexplode("seg").alias("at", "splitter")).join(ended.select(F.col("id").alias("splitter"), F.col("seg").alias("walk")), "splitter")
    whole = above.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "walk"))), lambda x: x["walk"])).alias("up"))
    paths = whole.select(F.col("id").alias("to"), F.reverse("up").alias("_above"))
    at_root = ended.filter(F.col("to").isNull()).select("id", top.alias("path"))
    below = ended.filter(F.col("to").isNotNull()).join(paths, "to").select("id", F.concat("_above", top).alias("path"))
    good = at_root.unionByName(below)
    out = good.select("id", F.element_at("path", 1).alias("root"), (F.size("path") - 1).alias("depth"), "path", F.lit(None).cast("string").alias("cycle_id"), F.lit(False).alias("on_cycle"))
    out = out.unionByName(done.bad.select("id", F.lit(None).cast("string").alias("root"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<string>").alias("path"), "cycle_id", "on_cycle"))
    if counts:
        n = _descendant_counts(ended, rooted)
        out = out.join(n, "id", "left").withColumn("n_descendants", F.when(F.col("path").isNotNull(), F.coalesce("n_descendants", F.lit(0).cast("bigint"))))
    return done.links.join(out, "id")


def _descendant_counts(ended: DataFrame, rooted: DataFrame) -> DataFrame:
    """(id, n_descendants) of nodes with any, folded up the reduced tree: a node's walk counts for what it passes and for the
    splitter it ends at, a splitter's total is that of the splitters beneath it, and counts for what its own walk passes."""
    passed = lambda d: d.select(F.explode(F.concat(F.slice("seg", F.lit(2), F.size("seg")), F.when(F.col("to").isNotNull(), F.array("to")).otherwise(F.array()))).alias("id"), "n")
    direct = materialize(passed(ended.withColumn("n", F.lit(1))).groupBy("id").agg(F.sum("n").alias("n")), "direct")
    of_splitter = rooted.join(direct, "id").select(F.explode("seg").alias("id"), "n").groupBy("id").agg(F.sum("n").alias("total"))
    # what a splitter's own walk passes on its way, but for the splitter at its end, whose total has it already
    on_the_way = ended.join(of_splitter, "id").select(F.explode(F.slice("seg", F.lit(2), F.size("seg"))).alias("id"), F.col("total").alias("n"))
    between = direct.join(of_splitter.select("id"), "id", "left_anti").unionByName(on_the_way).groupBy("id").agg(F.sum("n").alias("n_descendants"))
    return between.unionByName(of_splitter.select("id", F.col("total").alias("n_descendants")))


def descendants(tree: DataFrame) -> DataFrame:
    """(id, descendant, distance): all nodes beneath each node of hierarchy()'s result, one row per pair, so that a root
    with a third of all nodes beneath it is spread over tasks. Nodes of cycles have no rows."""
    placed = tree.filter(F.col("path").isNotNull() & (F.col("depth") > 0))
    pairs = placed.select("id", "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("at", "above"))
    return pairs.select(F.col("above").alias("id"), F.col("id").alias("descendant"), (F.col("depth") - F.col("at")).alias("distance"))
