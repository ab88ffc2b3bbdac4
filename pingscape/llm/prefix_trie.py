"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of the first d turns (role, text) of some conversation; the root
is the sequence of no turns.  Members of a node are the conversations that begin with it.

1. Every turn gets its number in its conversation and two 64-bit hashes of (number, role, text);
   the running exclusive ors of both name the prefix up to it.  A conversation of any length is
   the work of several tasks (`ordering.running`).
2. Rows of one prefix meet in salted pieces: the smallest member `rep` names the node, and
   (rep, depth) is its key.  The conversation `rep` passes all ancestors of the node, so
   an ancestor at any depth is one lookup by (conversation, depth): the paths.
3. Rollup along the parent edges, as the edges form a forest of components: in a component with
   top t the centroid z is the deepest node that holds at least half of its weight.  Weights of
   subtrees need no rollup: a node's is the sum, over the conversations that name nodes, of the
   turns from the node on.  The total of z's subtree in the component is added to all nodes on the path
   from z up to t, z is taken out, and its children's subtrees and the rest are components of
   their own.  A node's value reaches each ancestor exactly once: when a centroid on the path
   between them is taken out.
4. Weights at least halve, so after log2(all / LOCAL_WEIGHT) rounds, each a few joins and one saved
   table, every component is smaller than LOCAL_WEIGHT and is decomposed in the same way
   inside one task.

Defined results: null roles and texts are empty; turns are ordered by turn (null first), then
role, then text, so equal turn numbers and repeated rows count as turns of their own; rows without
conversation id are left out; an empty table without conversations has no node.  Texts are never cut
and leave their first shuffle as hashes and lengths.  Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingscape.llm.components import SALTS, leaders, salted
from pingscape.llm.ordering import running
from pingscape.llm.storage import saved

LOCAL_WEIGHT = 1 << 15
#: Ids of one piece of a digest.
PIECE_IDS = 1 << 14


def roll_up(parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of `values` (nodes x columns) by centroid decomposition; parents come before
    their children, the top has parent -1."""
    n = len(parent)
    size = np.ones(n, dtype=np.int64)
    for v in range(n - 1, 0, -1):
        size[parent[v]] += size[v]
    # places in preorder: a subtree is a stretch
    place, filled = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
    for v in range(1, n):
        u = parent[v]
        place[v] = place[u] + filled[u]
        filled[u] += size[v]
    node = np.argsort(place)
    size, value = size[node], values[node]
    end = np.arange(n) + size
    total = np.zeros_like(value)
    waiting = [np.arange(n)]
    while waiting:
        part = waiting.pop()
        if len(part) == 1:
            total[part[0]] += value[part[0]]
            continue
        # the deepest node with at least half of the component
        heavy = part[2 * size[part] >= len(part)]
        z = heavy[np.argmin(size[heavy])]
        at = int(np.searchsorted(part, z))
        below = part[at : at + size[z]]
        above, after = part[:at], part[at + size[z] :]
        path = above[end[above] > z]
        held = value[below].sum(axis=0)
        total[z] += held
        total[path] += held
        size[path] -= size[z]
        i = 1
        while i < len(below):
            j = i + int(size[below[i]])
            waiting.append(below[i:j])
            i = j
        if at:
            waiting.append(np.concatenate([above, after]) if len(after) else above)
    out = np.empty_like(total)
    out[node] = total
    return out


def _finished(parts: DataFrame) -> DataFrame:
    """(rep, depth, leaves, tokens): subtree sums inside components of bounded weight (top_rep, top_depth)."""
    ordered = parts.select("top_rep", "top_depth", "depth", "rep", "up", "leaves", "tokens").repartition("top_rep", "top_depth").sortWithinPartitions("top_rep", "top_depth", "depth", "rep")

    def solve(rep: list[int], depth: list[int], up: list[int], values: list[tuple[int, int]]) -> list[np.ndarray]:
        number = {key: i for i, key in enumerate(zip(rep, depth, strict=True))}
        parent = np.array([-1] + [number[u, d - 1] for u, d in zip(up[1:], depth[1:], strict=True)], dtype=np.int64)
        sums = roll_up(parent, np.array(values, dtype=np.int64))
        return [np.array(rep, np.int64), np.array(depth, np.int64), sums[:, 0], sums[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, rows, done, held = None, ([], [], [], []), [], 0

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*done, strict=True)], names=["rep", "depth", "leaves", "tokens"])

        for b in batches:
            for t, td, d, r, u, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if top != (t, td):
                    if top is not None:
                        done.append(solve(*rows))
                        held += len(rows[0])
                    top, rows = (t, td), ([], [], [], [])
                    if held > LOCAL_WEIGHT:
                        yield table()
                        done, held = [], 0
                for column, v in zip(rows, (r, d, u, (x, y)), strict=True):
                    column.append(v)
        if top is not None:
            done.append(solve(*rows))
            yield table()

    return ordered.mapInArrow(run, "rep long, depth long, leaves long, tokens long")


def _by_top(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """`rows` joined with one row of facts per component; the rows of a large component meet it in SALTS pieces."""
    pieces = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep", "depth"), F.lit(SALTS)).cast("int")).join(pieces, ["top_rep", "top_depth", "salt"]).drop("salt")


def subtree_sums(nodes: DataFrame, paths: DataFrame, local_weight: int = LOCAL_WEIGHT) -> DataFrame:
    """(rep, depth, leaves, tokens): sums over the subtrees of a forest by centroid decomposition.

    `nodes`: (rep, depth, up, weight, top_rep, top_depth, leaves, tokens), the parent of a node being
    (up, depth - 1), `weight` that of its subtree, and the component named by its top.  `paths`: (conv,
    depth, rep, up) for every node on the path of each conversation that names one.
    """
    credits, light = [], []
    while True:
        tops = nodes.where("rep = top_rep and depth = top_depth").select("top_rep", "top_depth", F.col("weight").alias("whole"))
        known = saved(_by_top(nodes, tops))
        light.append(known.where(F.col("whole") <= local_weight).drop("whole"))
        large = known.where(F.col("whole") > local_weight)
        if large.isEmpty():
            break
        # the deepest node with half of the weight: the lightest of those
        centre = large.where("2 * weight >= whole").groupBy("top_rep", "top_depth").agg(F.min(F.struct("weight", "rep", "depth")).alias("z"))
        centre = saved(centre.select("top_rep", "top_depth", F.col("z.rep").alias("z_rep"), F.col("z.depth").alias("z_depth"), F.col("z.weight").alias("z_weight")))
        met = _by_top(large, centre)
        # the node one below the centroid's depth on each deeper node's path, and whether the centroid is its parent
        step = paths.select(F.col("conv").alias("rep"), (F.col("depth") - 1).alias("z_depth"), F.col("rep").alias("child"), F.col("up").alias("over"))
        deeper = met.where("depth > z_depth").join(step, ["rep", "z_depth"])
        inside = F.col("over") == F.col("z_rep")
        rest = met.where("depth <= z_depth").withColumns({"child": F.lit(None).cast("long"), "inside": (F.col("rep") == F.col("z_rep")) & (F.col("depth") == F.col("z_depth"))})
        placed = saved(deeper.withColumn("inside", inside).drop("over").unionByName(rest))
        sums = placed.where("inside").groupBy("top_rep", "top_depth", "z_rep", "z_depth", "z_weight").agg(F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"))
        # the path from the centroid's parent to the top
        above = sums.where("z_depth > top_depth").withColumn("depth", F.explode(F.sequence(F.col("top_depth"), F.col("z_depth") - 1)))
        path = saved(above.join(paths.select(F.col("conv").alias("z_rep"), "depth", "rep"), ["z_rep", "depth"]).select("rep", "depth", "leaves", "tokens", "z_weight"))
        credits += [path.drop("z_weight"), sums.select(F.col("z_rep").alias("rep"), F.col("z_depth").alias("depth"), "leaves", "tokens")]
        left = placed.where("not inside").join(path.select("rep", "depth", F.col("z_weight").alias("lost")), ["rep", "depth"], "left")
        left = left.withColumn("weight", F.col("weight") - F.coalesce("lost", F.lit(0)))
        under = placed.where("inside and child is not null").withColumns({"top_rep": F.col("child"), "top_depth": F.col("z_depth") + 1})
        nodes = left.select(*nodes.columns).unionByName(under.select(*nodes.columns))
    small = light[0]
    for x in light[1:]:
        small = small.unionByName(x)
    found = _finished(small)
    for x in credits:
        found = found.unionByName(x.select("rep", "depth", "leaves", "tokens"))
    return found.groupBy("rep", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"))


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", local_weight: int = LOCAL_WEIGHT) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the trie.

    `nodes`: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.
    `ends`: (node, depth, conv_id), the node at which each conversation ends.
    `conversations` names, in its column `conv_col`, conversations that may have no turn.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).where("conv is not null")
    ordered = running(rows, "conv", ["turn", "role", "text"]).withColumn("depth", F.col("pos") + 1)
    hashed = ordered.select("conv", "depth", F.char_length("text").cast("long").alias("chars"), *[F.xxhash64(F.lit(i), "depth", "role", "text").alias(f"h{i}") for i in (1, 2)])
    steps = running(hashed, "conv", ["depth"], ["h1", "h2"]).drop("pos")

    key = ["depth", "h1", "h2"]
    named = salted(steps, "conv").join(leaders(steps, key, "conv"), [*key, "salt"])
    named = saved(named.select("conv", "depth", "chars", F.col("leader").alias("rep"), F.col("size").alias("n_convs")))
    # each conversation's last node, in pieces of long conversations
    part = salted(named, "depth").groupBy("conv", "salt").agg(F.max(F.struct("depth", "rep")).alias("last"))
    last = saved(part.groupBy("conv").agg(F.max("last").alias("last")))
    # a conversation that names nodes names its last one
    owned = salted(named, "depth").join(part.select("conv", "salt").join(last.where("last.rep = conv"), "conv"), ["conv", "salt"])
    owned = owned.select("conv", "depth", "rep", "chars", "n_convs", F.col("last.depth").alias("length"))

    given = rows.select("conv")
    if conversations is not None:
        given = given.unionByName(conversations.select(F.col(conv_col).cast("long").alias("conv")).where("conv is not null"))
    given = saved(given.distinct())
    least, n_all = given.agg(F.min("conv"), F.count("*")).first()
    root = given.where(F.col("conv") == F.lit(least)).select("conv", F.lit(0).cast("long").alias("depth"), F.col("conv").alias("rep"), F.lit(0).cast("long").alias("chars"), F.lit(n_all).cast("long").alias("n_convs"))
    start = last.where("last.rep = conv").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(least).cast("long").alias("rep"), F.lit(0).cast("long").alias("chars"), F.lit(n_all).cast("long").alias("n_convs"), F.col("last.depth").alias("length"))
    owned = saved(owned.unionByName(start))
    above = owned.select("conv", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("up"))
    paths = saved(owned.join(above, ["conv", "depth"], "left"))

    weights = paths.groupBy("rep", "depth").agg(F.sum(F.col("length") - F.col("depth") + 1).alias("weight"))
    base = paths.where("rep = conv and depth > 0").select("rep", "depth", "up", "chars", "n_convs").unionByName(root.select("rep", "depth", F.lit(None).cast("long").alias("up"), "chars", "n_convs"))
    children = base.where("depth > 0").groupBy(F.col("up").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    base = base.join(children, ["rep", "depth"], "left").join(weights, ["rep", "depth"], "left")
    base = saved(base.withColumns({"n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "weight": F.coalesce("weight", F.lit(1)).cast("long")}))

    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves")
    forest = base.select("rep", "depth", "up", "weight", F.lit(least).cast("long").alias("top_rep"), F.lit(0).cast("long").alias("top_depth"), leaf, ((F.col("n_convs") - 1) * F.col("chars")).alias("tokens"))
    sums = subtree_sums(forest, paths.select("conv", "depth", "rep", "up"), local_weight)
    nodes = base.join(sums, ["rep", "depth"]).select(F.col("rep").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens"))

    ends = given.join(last, "conv", "left").select(F.coalesce("last.rep", F.lit(least)).cast("long").alias("node"), F.coalesce("last.depth", F.lit(0)).cast("long").alias("depth"), F.col("conv").alias("conv_id"))
    return nodes, ends


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256): digest of the ascending, comma-joined ids of the conversations that end at a node.

    Ids are joined to pieces in parallel; a digest is sequential, so the pieces of one node
    stream through one task.
    """
    ordered = ends.repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE_IDS):
                node, depth, conv = (whole.column(c).slice(at, PIECE_IDS).to_numpy() for c in ("node", "depth", "conv_id"))
                head = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])))
                texts = conv.astype(str).tolist()
                joined = [",".join(texts[i:j]) for i, j in zip(head.tolist(), [*head[1:].tolist(), len(node)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node[head]), pa.array(depth[head]), pa.array(conv[head]), pa.array(joined)], names=["node", "depth", "first", "ids"])

    parts = ordered.mapInArrow(pieces, "node long, depth long, first long, ids string").repartition("node", "depth").sortWithinPartitions("node", "depth", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["node", "depth", "ends_sha256"])

        for b in batches:
            for node, depth, ids in zip(*(b.column(c).to_pylist() for c in ("node", "depth", "ids")), strict=True):
                if key == (node, depth):
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (node, depth), hashlib.sha256(ids.encode())
            if done:
                yield table()
                done = []
        if key is not None:
            done.append((*key, digest.hexdigest()))
            yield table()

    return parts.mapInArrow(run, "node long, depth long, ends_sha256 string")
