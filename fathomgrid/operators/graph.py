"""Graph operators over node and edge tables: adjacency, traversal, reachability, impact, dead code, communities and processes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.functions.text import CALLABLE
from fathomgrid.plans.durable import materialize, release
from fathomgrid.plans.skew import hot_keys, lookup_join

#: Weights of edges between members of a community.
WEIGHTS = {"calls": 1.0, "imports": 0.5, "extends": 2.0, "implements": 2.0, "member_of": 1.5}
#: A graph of so many edges and characters of identifiers at most is held whole by each task that traverses it.
MOST_EDGES, MOST_CHARS = 4_000_000, 64_000_000
#: Pairs of a traversal that are handed on as one row of lists.
PAIRS = 50_000


def neighbours(edges: DataFrame, nodes: DataFrame, rel_type: str, side: str) -> DataFrame:
    """(of, id, name, confidence): nodes at the other end of edges of a type. side 'callers': nodes that point at `of`; 'callees': those that `of` points at. A missing confidence is 1."""
    of, other = ("target", "source") if side == "callers" else ("source", "target")
    e = edges.where((F.col("rel_type") == rel_type) & F.col(of).isNotNull() & F.col(other).isNotNull())
    e = e.select(F.col(of).alias("of"), F.col(other).alias("id"), F.coalesce("confidence", F.lit(1.0)).alias("confidence")).groupBy("of", "id").agg(F.max("confidence").alias("confidence"))
    return lookup_join(e, nodes.select("id", "name"), "id", hot_keys(e, "id"), "inner").select("of", "id", "name", "confidence")


def traverse(edges: DataFrame, starts: DataFrame, most_depth: int = 10, side: str = "callees") -> DataFrame:
    """(start, id, depth): what each start reaches along the edges (source, target), at the depth of its first visit, without the start itself.

    Breadth first. The pairs can be thousands of times as many as the edges,
    so that a graph of up to MOST_EDGES edges and MOST_CHARS characters of
    identifiers is sent to the tasks, each of which follows its share of the
    starts and hands the pairs on without a shuffle or a table. A larger graph
    is joined in rounds. `starts` has the column start.
    """
    one = lambda a, b: edges.where(F.col("source").isNotNull() & F.col("target").isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    step = {"callees": lambda: one("source", "target"), "callers": lambda: one("target", "source"), "both": lambda: one("source", "target").unionByName(one("target", "source"))}[side]().distinct()
    step = materialize(step, "steps")
    hit = _followed(step, starts, most_depth) if step.count() <= MOST_EDGES else None
    if hit is None:
        hit = _joined(step, starts, most_depth)
    release(step.sparkSession, step)
    return hit


def _joined(step: DataFrame, starts: DataFrame, most_depth: int) -> DataFrame:
    """traverse over steps (a, b) of any number: each round joins the frontier to them and drops what was seen; rounds are written to the shared folder and end with the first that finds nothing."""
    frontier = starts.select("start", F.col("start").alias("id")).distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, most_depth + 1):
        new = frontier.join(step, F.col("id") == F.col("a")).select("start", F.col("b").alias("id")).distinct().join(seen.select("start", "id"), ["start", "id"], "left_anti")
        frontier = materialize(new, "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return seen.where("depth > 0")


def _followed(step: DataFrame, starts: DataFrame, most_depth: int) -> DataFrame | None:
    """traverse over steps (a, b) that every task holds whole; None where their identifiers exceed MOST_CHARS, or two of them share a hash.

    A task follows a block of starts at once, with one bit for each start at
    every node. Pairs leave Python as lists of places in the block, and become
    rows of identifiers when they are read.
    """
    spark, kind = step.sparkSession, step.schema["a"].dataType.simpleString()
    names = materialize(step.select(F.col("a").alias("id")).unionByName(step.select(F.col("b").alias("id"))).distinct().select("id", F.xxhash64("id").alias("key")), "names")
    chars, keys = names.agg(F.coalesce(F.sum(F.length(F.col("id").cast("string"))), F.lit(0)), F.countDistinct("key")).first()
    if chars > MOST_CHARS or keys < names.count():
        release(spark, names)
        return None
    named = names.toArrow()
    release(spark, names)
    order = np.argsort(key := named["key"].to_numpy())
    ids, key = named["id"].combine_chunks().take(pa.array(order)), key[order]
    number = lambda column: np.searchsorted(key, column.to_numpy()).astype(np.int32)
    pairs = step.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).toArrow()
    source, target = number(pairs["a"]), number(pairs["b"])
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    first = step.join(starts, F.col("a") == F.col("start"), "left_semi").select(F.xxhash64("a").alias("a")).distinct().toArrow()
    first = np.sort(number(first["a"]))
    words = min(16, max(1, 8_000_000 // max(1, len(source))))
    while words > 1 and len(first) < 128 * words * spark.sparkContext.defaultParallelism:  # two blocks for each core
        words //= 2
    blocks = -(-len(first) // (64 * words))
    shared = spark.sparkContext.broadcast((ids, source, target, first))  # MOST_EDGES and MOST_CHARS at most

    def run(batches):
        ids, source, target, first = shared.value
        for batch in batches:
            for block in batch.column(0).to_pylist():
                own = first[64 * words * block : 64 * words * (block + 1)]
                names = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), ids.take(pa.array(own)))
                for depth, nodes, bits in reached(len(ids), source, target, own, words, most_depth):
                    yield from lists(names, ids, depth, nodes, bits)

    def lists(names, ids, depth, nodes, bits):
        """Batches of one row for at most PAIRS pairs, and those of one more node: a row's pairs are held at once when it is spread."""
        ends = np.cumsum(np.bitwise_count(bits).sum(axis=1, dtype=np.int64))
        at = 0
        while at < len(nodes):
            before = ends[at - 1] if at else 0
            to = min(at + 8192, max(at + 1, int(np.searchsorted(ends, before + PAIRS, "right"))))
            octets = bits[at:to].view(np.uint8).ravel()
            some = np.flatnonzero(octets != 0)  # few are not
            bit = np.flatnonzero(np.unpackbits(octets[some], bitorder="little").view(bool))
            places = (some % (8 * words) * 8).astype(np.int16)[bit >> 3] | (bit & 7).astype(np.int16)
            places = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends[at:to] - before)), pa.int32()), pa.array(places))
            nodes_of = pa.StructArray.from_arrays([ids.take(pa.array(nodes[at:to])), places], ["id", "places"])
            yield pa.RecordBatch.from_arrays([names, pa.array([depth], pa.int32()), pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), nodes_of)], ["starts", "depth", "nodes"])
            at = to

    found = spark.range(0, blocks, 1, max(1, blocks)).mapInArrow(run, f"starts array<{kind}>, depth int, nodes array<struct<id: {kind}, places: array<smallint>>>")
    each = found.select("starts", "depth", F.explode("nodes").alias("node")).select("starts", "depth", "node.id", F.explode("node.places").alias("place"))
    return each.select(F.get("starts", "place").alias("start"), "id", "depth")


def reached(n: int, source: np.ndarray, target: np.ndarray, starts: np.ndarray, words: int, most_depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, nodes, bits) for each depth from 1 on at which some of the starts (64 * words at most) first visit any of the nodes 0 to n - 1: in bits, a row for each of those nodes, bit i stands for the start i. Edges are sorted by target."""
    place = np.arange(len(starts))
    frontier = np.zeros((n, words), "<u8")
    np.bitwise_or.at(frontier, (starts, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    seen, live = frontier.copy(), starts
    for depth in range(1, most_depth + 1):
        is_live = np.zeros(n, bool)
        is_live[live] = True
        some = np.flatnonzero(is_live[source])
        if not len(some):
            return
        to = target[some]
        at = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        nodes = to[at]
        bits = np.bitwise_or.reduceat(frontier[source[some]], at, axis=0) & ~seen[nodes]
        new = bits.any(axis=1)
        frontier[live] = 0
        live, bits = nodes[new], bits[new]
        if not len(live):
            return
        frontier[live] = bits
        seen[live] |= bits
        yield depth, live, bits


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id): all that any start reaches, however far, the starts included, without keeping which start reached what."""
    step = materialize(edges.where("source is not null and target is not null").select("source", "target").distinct(), "steps")
    frontier = materialize(starts.select("id").distinct(), "frontier")
    seen = [frontier]
    while True:  # each round adds nodes, so that it ends
        every = reduce(DataFrame.unionByName, seen)
        frontier = materialize(frontier.join(step, F.col("id") == F.col("source")).select(F.col("target").alias("id")).distinct().join(every, "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen.append(frontier)
    release(step.sparkSession, step)
    return reduce(DataFrame.unionByName, seen)


def impact(edges: DataFrame, starts: DataFrame, most_depth: int = 3) -> DataFrame:
    """(start, id, depth, effect): callers up to one step beyond most_depth, as will break, may break or review."""
    hit = traverse(edges, starts, most_depth + 1, "callers")
    return hit.withColumn("effect", F.when(F.col("depth") == 1, "will break").when(F.col("depth") == 2, "may break").otherwise("review"))


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Callable nodes that are exported, entries, or never called."""
    called = edges.where("rel_type = 'calls' and target is not null").select(F.col("target").alias("id")).distinct()
    some = nodes.where(F.col("label").isin(*CALLABLE))
    marked = (F.col("is_exported") == 1) | (F.col("is_entry_point") == 1)
    return some.where(marked).unionByName(some.where(~F.coalesce(marked, F.lit(False))).join(called, "id", "left_anti"))


def live_roots(nodes: DataFrame) -> DataFrame:
    """Nodes that are alive whatever calls them: exported, main, tests, constructors and special methods, and test classes."""
    name, path = F.col("name"), F.col("file_path")
    callable_ = F.col("label").isin(*CALLABLE)
    in_tests = path.contains("/test/") | path.contains("/tests/")
    test = name.startswith("test_") | name.startswith("it_") | name.startswith("describe_") | in_tests | path.contains("/__tests__/") | path.rlike(r"\.(test|spec)\.(ts|js)$")
    special = name.isin("main", "__main__", "constructor") | name.rlike("^__.*__$")
    test_class = (F.col("label") == "class") & (name.startswith("Test") | name.rlike("Tests?$") | in_tests)
    return nodes.where((callable_ & ((F.col("is_exported") == 1) | special | test)) | test_class).select("id")


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, file_path): callable nodes that no root reaches by calls and that override no reached method."""
    calls = edges.where("rel_type = 'calls'")
    alive = materialize(reachable(calls, live_roots(nodes)), "alive")
    unreached = nodes.where(F.col("label").isin(*CALLABLE)).join(alive, "id", "left_anti")
    kin = edges.where("rel_type in ('extends', 'implements') and target is not null").select(F.col("source").alias("child"), F.col("target").alias("parent")).distinct()
    member = edges.where("rel_type = 'member_of' and target is not null").select(F.col("source").alias("member"), F.col("target").alias("owner")).distinct()
    named = nodes.select(F.col("id").alias("member"), F.col("name").alias("m_name"), F.col("label").alias("m_label"))
    methods = member.join(named, "member")
    parents = methods.join(alive.select(F.col("id").alias("member")), "member", "left_semi").select(F.col("owner").alias("parent"), F.col("m_name").alias("p_name"))
    spared = methods.where("m_label = 'method'").join(kin, F.col("owner") == F.col("child")).join(parents, "parent").where("m_name = p_name").select(F.col("member").alias("id")).distinct()
    return unreached.join(spared, "id", "left_anti").select("id", "name", "file_path")


def weighted_links(edges: DataFrame) -> DataFrame:
    """(a, b, w), both directions: the summed weights of the edges between two nodes; a loop counts twice."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("rel_type"))
    e = edges.where(F.col("rel_type").isin(*WEIGHTS) & F.col("source").isNotNull() & F.col("target").isNotNull()).withColumn("w", weight)
    both = e.select(F.col("source").alias("a"), F.col("target").alias("b"), "w").unionByName(e.select(F.col("target").alias("a"), F.col("source").alias("b"), "w"))
    return both.groupBy("a", "b").agg(F.sum("w").alias("w"))


def communities(links: DataFrame, rounds: int = 100, least: int = 2) -> DataFrame:
    """(id, community, settled) by synchronous label propagation: each node takes the label with the greatest weight among its neighbours and itself (which votes with its mean link, against swinging), least label first.

    The local moving of one node after the other depends on the order of the
    nodes and can't be spread over tasks; this variant has the same goal, is
    deterministic and scales with the number of links. Each round aggregates
    partially by (node, label) before it picks. Rounds are written to the
    shared folder; they end when no label changes, when all that change swing
    between two labels (which then take the lesser), or after `rounds`.
    settled is false for nodes that still changed. Communities of less than
    `least` members are left out.
    """
    spark = links.sparkSession
    links = materialize(links.where("a <> b"), "links")
    labels = materialize(links.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("community"), F.lit(None).cast("string").alias("last")), "labels")
    own = links.groupBy("a").agg(F.avg("w").alias("w"))
    hot = hot_keys(links, "b")
    for _ in range(rounds):
        votes = lookup_join(links, labels.select(F.col("id").alias("b"), "community"), "b", hot, "inner").select("a", "community", "w").unionByName(own.join(labels, F.col("a") == F.col("id")).select("a", "community", "w"))
        sums = votes.groupBy("a", "community").agg(F.sum("w").alias("w"))
        pick = sums.groupBy(F.col("a").alias("id")).agg(F.min_by("community", F.struct(-F.round("w", 9), "community")).alias("new"))
        old = labels
        both = materialize(pick.join(old, "id").select("id", F.col("new").alias("community"), F.col("community").alias("last"), F.col("last").alias("before")), "labels")
        release(spark, old)
        labels = both.select("id", "community", "last")
        moved, strayed = both.agg(F.count_if(F.expr("community <> last")), F.count_if(F.expr("not (community <=> before)"))).first()
        if not moved or not strayed:
            break
    ended = labels.select("id", F.least("community", "last").alias("community"), (F.col("community") == F.col("last")).alias("settled")) if rounds and moved and not strayed else labels.select("id", "community", F.coalesce(F.col("community") == F.col("last"), F.lit(False)).alias("settled"))
    large = ended.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("community")
    return ended.join(large, "community", "left_semi").select("id", "community", "settled")


def modularity(links: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the sum over pairs of nodes of one community, each pair once, of (a_ij - resolution k_i k_j / 2m) / 2m, in closed form per community."""
    degree = links.groupBy("a").agg(F.sum("w").alias("k"))
    two_m = links.agg(F.sum("w").alias("m2"))
    per = degree.join(labels, F.col("a") == F.col("id")).groupBy("community").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
    la, lb = labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), labels.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    inside = links.where("a < b").join(la, "a").join(lb, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("w").alias("within"))
    rows = per.join(inside, "community", "left").withColumn("within", F.coalesce("within", F.lit(0.0))).join(F.broadcast(two_m))  # one row
    return rows.agg((F.sum((F.col("within") - resolution * (F.col("s") * F.col("s") - F.col("q")) / 2 / F.col("m2")) / F.col("m2"))).alias("modularity"))


def cohesion(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, members, cohesion, hub): the share of its members' link weight that stays inside (1 below two members), and the member with the most of it, least identifier first."""
    la, lb = labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), labels.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    own = links.join(la, "a").join(lb, "b").groupBy("ca", "a").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inner"), F.sum("w").alias("all"))
    per = own.groupBy(F.col("ca").alias("community")).agg(F.sum("inner").alias("inner"), F.sum("all").alias("all"), F.min_by("a", F.struct(-F.col("inner"), "a")).alias("hub"))
    size = labels.groupBy("community").agg(F.count(F.lit(1)).alias("members"))
    share = F.when(F.col("members") < 2, 1.0).when(F.col("all") > 0, F.col("inner") / F.col("all")).otherwise(0.0)
    return size.join(per, "community").select("community", "members", share.alias("cohesion"), "hub")


def processes(nodes: DataFrame, edges: DataFrame, most_depth: int = 10, fan_out: int = 3, least: int = 3, most: int = 20) -> DataFrame:
    """(entry, position, id, depth): from every entry point, calls in breadth-first order with at most fan_out callees (least identifiers) per node.

    Flows of less than `least` or more than `most` steps are left out. Each
    entry is followed by itself; no flow depends on another, so that entries
    can be spread over tasks. Then flows that overlap are merged.
    """
    calls = edges.where("rel_type = 'calls' and target is not null").select("source", "target").distinct()
    top = calls.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("target"))).where(F.col("n") <= fan_out).select("source", "target")
    hit = traverse(top, entry_points(nodes, edges).select(F.col("id").alias("start")), most_depth, "callees")
    steps = hit.unionByName(hit.select("start").distinct().select("start", F.col("start").alias("id"), F.lit(0).alias("depth")))
    numbered = steps.withColumn("position", F.row_number().over(Window.partitionBy("start").orderBy("depth", "id")) - 1).withColumn("steps", F.count(F.lit(1)).over(Window.partitionBy("start")))
    return merge_overlapping(numbered.where((F.col("steps") >= least) & (F.col("steps") <= most)).select(F.col("start").alias("entry"), "position", "id", "depth"))


def merge_overlapping(flows: DataFrame) -> DataFrame:
    """The flows (entry, position, id, depth) that are kept when each flow in turn, least entry first, takes all that share a node with it and aren't taken yet, and of these the longest stays, the last among equals.

    A flow takes others if no lesser one takes it, so that the turns are found
    in rounds: a flow that is the least at all of its nodes is sure to take,
    and what it touches is out, until none is left. Flows meet at their nodes;
    pairs of flows are not formed.
    """
    flows = materialize(flows, "flows")
    every = flows.select("entry", "id").distinct()
    active, takers = every, []
    while not active.isEmpty():
        first = active.groupBy("id").agg(F.min("entry").alias("first"))
        takes = active.join(first, "id").groupBy("entry").agg(F.min("first").alias("first")).where("entry = first").select("entry")
        takers.append(materialize(active.join(takes, "entry", "left_semi"), "takers"))
        out = active.join(takers[-1].select("id").distinct(), "id", "left_semi").select("entry").distinct()
        active = materialize(active.join(out, "entry", "left_anti"), "active")
    if not takers:
        return flows
    taken = every.join(reduce(DataFrame.unionByName, takers).select("id", F.col("entry").alias("taker")), "id").groupBy("entry").agg(F.min("taker").alias("taker"))
    steps = flows.groupBy("entry").agg(F.count(F.lit(1)).alias("steps"))
    kept = taken.join(steps, "entry").groupBy("taker").agg(F.max_by("entry", F.struct("steps", "entry")).alias("entry")).select("entry")
    return flows.join(kept, "entry", "left_semi")


def structure(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folders and files as (id, label), contains edges as (source, target)) from file paths."""
    parts = F.split("file_path", "/")
    prefix = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    up = files.select("file_path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"), F.size(parts).alias("of"))
    label = F.when(F.col("n") == F.col("of"), "file").otherwise("folder")
    rows = up.select(prefix(F.col("n")).alias("id"), label.alias("label"), F.when(F.col("n") > 1, prefix(F.col("n") - 1)).alias("parent")).distinct()
    return rows.select("id", "label"), rows.where("parent is not null").select(F.col("parent").alias("source"), F.col("id").alias("target"))


def enclosing_symbol(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """points (file_path, line) with the id of the narrowest symbol (file_path, id, start_line, end_line) whose lines hold them; null where none does. The join is on the file, so that a range is compared with its own file's lines only."""
    s = symbols.select(F.col("file_path").alias("_f"), F.col("id").alias("_id"), "start_line", "end_line")
    hit = points.join(s, (F.col("file_path") == F.col("_f")) & (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line")))
    best = hit.groupBy("file_path", "line").agg(F.min_by("_id", F.struct(F.col("end_line") - F.col("start_line"), "_id")).alias("symbol"))
    return points.join(best, ["file_path", "line"], "left")


def common_prefix_name(names: pd.Series) -> str:
    """A shared prefix of three characters or more, with a star; else the first name."""
    import os

    rows = sorted(x for x in names if x)
    prefix = os.path.commonprefix(rows) if rows else ""
    return f"{prefix}*" if len(prefix) >= 3 and len(rows) > 1 else (rows[0] if rows else "")
