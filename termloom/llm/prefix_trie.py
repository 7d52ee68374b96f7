"""The trie of the shared beginnings of conversations, and sums over its subtrees.

A node is a sequence of turns that some conversation starts with. It is named by its smallest member
and its depth. Subtree sums follow a centroid decomposition of the parent edges: a component is split
at the node whose subtree just holds half of its weight, the totals of the parts below that node are added
to the nodes between it and the top of the component, and the parts are split in turn. Components of more
nodes than a task takes are split by joins, all of them in one round; a smaller component goes to one task whole.

Joins to a table with a row per conversation or node are hinted: by the bytes of its packed file Spark would broadcast
millions of its rows through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import WORD, join_groups
from termloom.plans.staging import shuffle_width, write_stage

# A component of up to this many nodes is decomposed in one task; the method and the result are the same.
TASK_NODES = 20_000
# Conversation ids in one text, as they are handed to the digest of a node.
IDS_A_TEXT = 20_000
NODE = ["depth", "n1", "n2"]


def running(rows: DataFrame, key: str, order: list[str], scans: dict[str, tuple]) -> DataFrame:
    """``rows`` with running aggregates within each key, where one key may hold most rows.

    ``scans`` gives for a new column its aggregate, its value on an empty range and the function that
    joins two ranges. Rows are dealt by ranges of (key, order), summed within each range, and the keys that lie in
    several ranges, at most one for each border, get what the ranges before hold.
    """
    n = shuffle_width(rows.sparkSession)
    dealt = write_stage(rows.repartitionByRange(n, key, *order).withColumn("range", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dealt.groupBy(key, "range").agg(*(made.alias(c) for c, (made, _, _) in scans.items()))
    split = sums.groupBy(key).agg(F.count("*").alias("ranges")).filter("ranges > 1").drop("ranges")
    earlier = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.join(split, key)
    merged = {"count": F.sum, "bit_xor": F.bit_xor}
    before = before.select(key, "range", *(merged[kind](c).over(earlier).alias(f"before_{c}") for c, (_, kind, _) in scans.items()))
    done = dealt.select("*", *(made.over(here).alias(f"here_{c}") for c, (made, _, _) in scans.items()))
    done = done.join(F.broadcast(before), [key, "range"], "left")
    for c, (_, _, both) in scans.items():
        done = done.withColumn(c, both(F.col(f"here_{c}"), F.coalesce(f"before_{c}", F.lit(0)))).drop(f"here_{c}", f"before_{c}")
    return done.drop("range")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, words): the turns of each conversation from 1, with 128 bits of role and text.

    Turns are ordered by turn (null first); equal ones by role and then by the hash of the text, so rows that
    repeat in whole follow one another. Null role or text is empty. Rows without conv_id take no part.
    """
    said = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"),
        F.col("turn").isNotNull().alias("has_turn"),
        said[0].alias("role"),
        F.xxhash64(F.lit(1), *said).alias("t1"),
        F.xxhash64(F.lit(2), *said).alias("t2"),
        F.size(F.regexp_extract_all(said[1], F.lit(WORD), F.lit(0))).cast("long").alias("words"),
    )
    order = ["has_turn", "turn", "role", "t1", "t2"]
    found = running(turns, "conv_id", order, {"pos": (F.count("*"), "count", lambda a, b: a + b)})
    return found.select("conv_id", "pos", "t1", "t2", "words")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with their length, turns with depth and length) of numbered turns."""
    convs = write_stage(turns.groupBy("conv_id").agg(F.max("pos").alias("length")), "conversations")
    return convs, join_groups(turns.withColumnRenamed("pos", "depth"), convs, ["conv_id"])


def with_shared_heads(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """The same of rebuilt conversations.

    Conversation c starts with the first h turns of conversation c - c % every, h = crc32(decimal c) % heads
    (all if it has fewer, none if it is absent), and goes on with its own turns after its first h.
    """
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    convs = write_stage(convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads), "conversations")
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(lengths.hint("merge"), "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = convs.withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = write_stage(convs.select("conv_id", "base", "h", "m", "length"), "conversations")
    own = join_groups(turns, convs.drop("base"), ["conv_id"]).filter("pos > h").withColumn("depth", F.expr("pos - h + m"))
    shared = turns.filter((F.col("pos") < heads) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    shared = shared.join(convs.drop("h").hint("merge"), "base").filter("pos <= m").withColumnRenamed("pos", "depth")
    columns = ["conv_id", "depth", "t1", "t2", "words", "length"]
    return convs.select("conv_id", "length"), own.select(columns).unionByName(shared.select(columns))


def trie_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, n1, n2, p1, p2, words, length): the node of each turn and its parent.

    A node's 128 bits are the exclusive or of the hashes of (place, turn) up to it, so they need no order
    of work within a conversation. Prefixes are equal if depth and bits are.
    """
    placed = turns.withColumns(
        {"x1": F.xxhash64(F.lit(3), "depth", "t1", "t2"), "x2": F.xxhash64(F.lit(4), "t2", "depth", "t1")}
    ).select("conv_id", "depth", "x1", "x2", "words", "length")
    both = lambda a, b: a.bitwiseXOR(b)
    found = running(
        placed, "conv_id", ["depth"], {"n1": (F.bit_xor("x1"), "bit_xor", both), "n2": (F.bit_xor("x2"), "bit_xor", both)}
    )
    found = found.withColumns({"p1": F.col("n1").bitwiseXOR(F.col("x1")), "p2": F.col("n2").bitwiseXOR(F.col("x2"))})
    return write_stage(found.drop("x1", "x2"), "paths")


def trie_nodes(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per node, the root included, with its smallest member, its parent's, and its own share of the sums.

    ``weight`` counts the turns (and roots) of the members from the node on: the weight of its subtree.
    """
    below = F.sum(F.col("length") - F.col("depth") + 1).alias("weight")
    members = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), below]
    nodes = paths.groupBy(*NODE, "p1", "p2").agg(*members)
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "n1", "n2")]
    root = convs.select("conv_id", "length", F.lit(0).cast("long").alias("words"), *zero).groupBy(*NODE).agg(*members)
    root = root.withColumns({"p1": F.lit(None).cast("long"), "p2": F.lit(None).cast("long")})
    nodes = write_stage(nodes.unionByName(root.select(nodes.columns)), "nodes")
    names = nodes.select((F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.filter("p1 IS NOT NULL").groupBy(F.col("depth") - 1, "p1", "p2").agg(F.count("*").alias("n_children"))
    children = children.toDF(*NODE, "n_children")
    # A node may be the parent of a great part of all nodes; adaptive execution splits the children's side of the join.
    nodes = nodes.join(names.hint("merge"), ["depth", "p1", "p2"], "left").join(children.hint("merge"), NODE, "left")
    return write_stage(
        nodes.na.fill(0, ["n_children"]).select(
            "conv_id", *NODE, "parent_conv_id", "n_convs", "n_children", "weight",
            F.expr("CAST(n_children = 0 AS LONG)").alias("leaf"),
            F.expr("(n_convs - 1) * words").alias("saved"),
        ),
        "nodes",
    )


def _owners(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, owner, parent_owner): the smallest member of each node on a conversation's path."""
    names = nodes.select(*NODE, F.col("conv_id").alias("owner"), F.col("parent_conv_id").alias("parent_owner"))
    named = paths.select("conv_id", *NODE).join(names.hint("merge"), NODE).select("conv_id", "depth", "owner", "parent_owner")
    # Paths start below the root.
    root = named.filter("depth = 1").select("conv_id", F.lit(0).cast("long"), "parent_owner", F.lit(None).cast("long"))
    return write_stage(named.union(root), "owners")


def split_large(state: DataFrame, owners: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of splits: (components after it, centroids with the sums of their subtrees).

    ``large`` has the components to split, with the weight of their top.
    """
    comp = ["comp", "top"]
    weighed = join_groups(state, large, comp)
    heavy = weighed.filter(2 * F.col("weight") >= F.col("whole"))
    # Nodes with half of the weight below lie on one path; the lightest is the deepest.
    centre = F.min_by(F.struct("conv_id", "depth", "weight"), "weight")
    cuts = heavy.groupBy(*comp).agg(centre.alias("cut"))
    cuts = cuts.select(*comp, *(F.col(f"cut.{c}").alias(n) for c, n in (("conv_id", "c_conv"), ("depth", "c_depth"), ("weight", "c_weight"))))
    cuts = write_stage(cuts, "cuts")
    rows = join_groups(state, cuts, comp)
    # The node one below the cut on the way to each deeper node: its parent tells whether the node lies below the cut.
    deeper = rows.filter("depth > c_depth").withColumn("step", F.col("c_depth") + 1)
    steps = owners.select(F.col("conv_id"), F.col("depth").alias("step"), "owner", "parent_owner")
    deeper = deeper.join(steps.hint("merge"), ["conv_id", "step"])
    deeper = deeper.withColumn("under", F.col("parent_owner") == F.col("c_conv"))
    level = rows.filter("c_conv IS NOT NULL AND depth <= c_depth")
    is_cut = (F.col("conv_id") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
    below = deeper.filter("under")
    parts = below.select(*comp, "leaf", "saved").unionByName(level.filter(is_cut).select(*comp, "leaf", "saved"))
    totals = parts.groupBy(*comp).agg(F.sum("leaf").alias("t_leaf"), F.sum("saved").alias("t_saved"))
    cuts = write_stage(cuts.join(totals, comp), "cuts")
    solved = level.filter(is_cut).join(cuts.select("c_conv", "c_depth", "t_leaf", "t_saved"), ["c_conv", "c_depth"])
    solved = solved.select("conv_id", "depth", F.expr("add_leaf + t_leaf").alias("n_leaves"), F.expr("add_saved + t_saved").alias("saved_tokens"))
    # The way from the cut to the top, by the path of the cut's own conversation, in stretches of a fixed length.
    stretch = lambda depth: F.floor(F.col(depth) / TASK_NODES)
    ways = cuts.filter("c_depth > top").withColumn("stretch", F.explode(F.sequence(stretch("top"), stretch("c_depth"))))
    ways = ways.select(F.col("c_conv").alias("conv_id"), "stretch", "top", "c_depth", F.col("c_weight").alias("less"), "t_leaf", "t_saved")
    way = owners.withColumn("stretch", stretch("depth")).join(ways, ["conv_id", "stretch"])
    way = way.filter("depth >= top AND depth < c_depth").select(F.col("owner").alias("conv_id"), "depth", "less", "t_leaf", "t_saved")
    upper = level.filter(~is_cut).select(state.columns).unionByName(deeper.filter("NOT under").select(state.columns))
    upper = upper.join(way, ["conv_id", "depth"], "left").na.fill(0, ["less", "t_leaf", "t_saved"])
    upper = upper.withColumns({"weight": F.expr("weight - less"), "add_leaf": F.expr("add_leaf + t_leaf"), "add_saved": F.expr("add_saved + t_saved")})
    below = below.withColumns({"comp": F.col("owner"), "top": F.col("step")})
    kept = rows.filter("c_conv IS NULL").select(state.columns)
    state = kept.unionByName(upper.select(state.columns)).unionByName(below.select(state.columns))
    return write_stage(state, "components"), write_stage(solved, "solved")


def _roots(parent: np.ndarray) -> np.ndarray:
    """The top of the component of each node."""
    up = np.where(parent < 0, np.arange(len(parent)), parent)
    while not np.array_equal(higher := up[up], up):
        up = higher
    return up


def decompose(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of the rows of ``values`` by centroid decomposition, for all components of a forest at once.

    ``parent`` has the place of each node's parent, -1 at the top of a component.
    """
    n, parent = len(parent), parent.copy()
    sums, size = np.zeros_like(values), np.ones(n, np.int64)
    order = np.argsort(-depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[order])) + 1
    for some in np.split(order, edges):
        np.add.at(size, parent[some[parent[some] >= 0]], size[some[parent[some] >= 0]])
    alive = np.arange(n)
    while len(alive):
        tops = _roots(parent)[alive]
        heavy = 2 * size[alive] >= size[tops]
        nodes, tops_of = alive[heavy], tops[heavy]
        ranked = np.lexsort((size[nodes], tops_of))
        first = np.concatenate([[True], np.diff(tops_of[ranked]) != 0])
        cuts = nodes[ranked[first]]
        is_cut = np.zeros(n, bool)
        is_cut[cuts] = True
        above = parent[cuts]
        child = alive[(parent[alive] >= 0) & is_cut[parent[alive]]]
        under = parent[child]
        parent[child], parent[cuts] = -1, -1
        # Totals of the parts, summed up for the cut that they hang from.
        part = _roots(parent)[alive]
        totals = np.zeros_like(values)
        np.add.at(totals, part, values[alive])
        hung = totals[cuts]
        place = np.empty(n, np.int64)
        place[cuts] = np.arange(len(cuts))
        np.add.at(hung, place[under], totals[child])
        sums[cuts] += hung
        going = np.flatnonzero(above >= 0)
        at = above[going]
        while len(at):
            sums[at] += hung[going]
            size[at] -= size[cuts[going]]
            at = parent[at]
            going, at = going[at >= 0], at[at >= 0]
        alive = alive[~is_cut[alive]]
    return sums


def _places(conv: np.ndarray, depth: np.ndarray, comp: np.ndarray, top: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The place of each node's parent among the nodes, -1 at a top."""
    convs, code = np.unique(conv, return_inverse=True)
    high = int(depth.max()) + 2
    keys = code * high + depth
    order = np.argsort(keys)
    is_top = (conv == comp) & (depth == top)
    found = np.searchsorted(keys[order], np.searchsorted(convs, above) * high + depth - 1)
    return np.where(is_top, -1, order[np.minimum(found, len(conv) - 1)])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtree sums of the components of a sorted partition, some whole components at a time."""

    def solved(run: pa.Table) -> pa.RecordBatch:
        c = {name: run[name].fill_null(-1).to_numpy() for name in run.column_names}  # the root has no parent
        parent = _places(c["conv_id"], c["depth"], c["comp"], c["top"], c["parent"])
        sums = decompose(parent, c["depth"], np.stack([c["leaf"], c["saved"]], axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (c["conv_id"], c["depth"], sums[:, 0] + c["add_leaf"], sums[:, 1] + c["add_saved"])],
            ["conv_id", "depth", "n_leaves", "saved_tokens"],
        )

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < 100_000:
            continue
        run = pa.Table.from_batches(held)
        comp, top = (run[x].to_numpy() for x in ("comp", "top"))
        borders = np.flatnonzero((np.diff(comp) != 0) | (np.diff(top) != 0))
        if len(borders):
            end = int(borders[-1]) + 1
            yield solved(run[:end])
            held = run[end:].combine_chunks().to_batches()
    if sum(b.num_rows for b in held):
        yield solved(pa.Table.from_batches(held))


def subtree_sums(nodes: DataFrame, paths: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of each node's subtree."""
    root, zero = nodes.filter("depth = 0").select("conv_id").first(), F.lit(0).cast("long")
    state = nodes.select(
        "conv_id", "depth", F.col("parent_conv_id").alias("parent"), "weight", "leaf", "saved",
        F.lit(root.conv_id if root else 0).cast("long").alias("comp"), zero.alias("top"),
        zero.alias("add_leaf"), zero.alias("add_saved"),
    )
    solved, owners = [], None
    while True:
        sizes = state.groupBy("comp", "top").agg(F.count("*").alias("n"), F.max("weight").alias("whole"))
        large = write_stage(sizes.filter(F.col("n") > task_nodes).drop("n"), "large")
        if large.isEmpty():
            break
        owners = owners or _owners(paths, nodes)
        state, done = split_large(state, owners, large)
        solved.append(done)
    rest = state.drop("weight").repartition("comp", "top").sortWithinPartitions("comp", "top")
    found = rest.mapInArrow(_solve, "conv_id long, depth long, n_leaves long, saved_tokens long")
    for done in solved:
        found = found.unionByName(done)
    return found


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a sorted partition as texts of some thousand ids of one node each."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [batch.column(c).to_numpy() for c in range(3)]
        new = np.any([np.diff(k) != 0 for k in keys], axis=0)
        run = np.concatenate([[0], np.cumsum(new)])
        start = np.flatnonzero(np.concatenate([[True], new]))
        within = np.arange(n) - start[run]
        firsts = np.flatnonzero(within % IDS_A_TEXT == 0)
        ids = pc.cast(batch.column(3), pa.string())
        lists = pa.ListArray.from_arrays(pa.array(np.append(firsts, n), pa.int32()), ids)
        taken = pa.array(firsts)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(taken) for c in range(4)), pc.binary_join(lists, ",")], [*NODE, "first_id", "ids"]
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's texts, which follow one another; only the running digest is held."""
    node, digest = None, None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
        out = []
        for key, ids in zip(keys, batch.column(4).to_pylist()):
            if key == node:
                digest.update(b"," + ids.encode())
                continue
            if node is not None:
                out.append((*node, digest.hexdigest()))
            node, digest = key, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], [*NODE, "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], [*NODE, "ends_sha256"])


def end_digests(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """(depth, n1, n2, ends_sha256): SHA-256 of the ids of the conversations that end at a node, in their order.

    Ids become texts in ranges of (node, id), so a node where many end is worked on by many tasks; what
    one task then reads of it is a few texts, which it digests one after another.
    """
    zero = F.lit(0).cast("long")
    ends = paths.filter("depth = length").select(*NODE, "conv_id")
    ends = ends.unionByName(convs.filter("length = 0").select(zero.alias("depth"), zero.alias("n1"), zero.alias("n2"), "conv_id"))
    n = shuffle_width(convs.sparkSession)
    kinds = "depth long, n1 long, n2 long"
    texts = ends.repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    texts = texts.mapInArrow(_ids, f"{kinds}, first_id long, ids string")
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "first_id").mapInArrow(_digests, f"{kinds}, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, depth, t1, t2, words, length).

    ``convs`` (conv_id, length) also has conversations without turns: members of the root. No conversation, no row.
    """
    paths = trie_paths(turns)
    nodes = trie_nodes(convs, paths)
    sums = subtree_sums(nodes, paths, task_nodes)
    none = hashlib.sha256(b"").hexdigest()
    found = nodes.join(sums.hint("merge"), ["conv_id", "depth"]).join(end_digests(convs, paths).hint("merge"), NODE, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
