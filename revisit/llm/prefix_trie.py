"""The trie of conversation prefixes, rolled up by centroid decomposition of its parent edges.

A node is a distinct sequence of first turns, named by a hash of the sequence. Totals over subtrees
are made without walking the trie level by level, which would take as many jobs as the longest
conversation has turns: a component of n nodes is split at its centroid, the lowest node that has
at least half of the component at or below itself. What lies at or below the centroid is summed and
added to every node on the way from the centroid to the component's top; the subtrees under the
centroid and the rest above it are the next components. So there are log2 n rounds. Components of
at most ``most_local`` nodes are finished side by side inside tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.llm.bounded import small
from revisit.operators.scan import Running, place, segmented_scan
from revisit.plans.durable import durable, durable_at, forget

MOST_LOCAL = 4096
HEAVY = 100_000  # rows of one key above which the key's partner is broadcast
SHARED = 9  # a rebuilt conversation shares fewer than so many turns with its family's first one
FAMILY = 5
_TEXT_KEY = 32  # characters of roles and texts that order turns of equal number
_CHUNK = 1 << 20  # characters of joined ids that are hashed together


# ------------------------------------------------------------------ conversations


def placed_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, place, a, b, bytes): every turn's place in its conversation, from 1, and its hashes.

    Null turn numbers come first; turns of equal number are ordered by the first characters of role
    and text, then by hash, and repeated rows are turns of their own. Null roles and texts are
    empty. Rows without a conversation id belong to none. Texts are hashed before anything moves.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        *[F.left(s, F.lit(_TEXT_KEY)).alias(n) for s, n in zip(said, ("r", "t"))],
        F.xxhash64(F.lit(11), *said).alias("a"), F.xxhash64(F.lit(23), *reversed(said)).alias("b"),
        F.octet_length(said[1]).cast("long").alias("bytes"),
    )
    counted = {"place": Running("sum", "1")}
    made = segmented_scan(rows, ["conv"], ["turn", "r", "t", "a", "b"], counted)
    return made.select("conv", F.col("place").cast("long").alias("place"), "a", "b", "bytes")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first one of their family: (turns, conversations).

    Conversation c takes the first h turns of c - c % 5, as far as there are any, and its own turns
    after its first h; h is crc32(decimal c) % 9. Turns are (conv, part, place, a, b, bytes) in the
    order of (part, place); a conversation may have none.
    """
    h = F.crc32(F.col("conv").cast("string")) % SHARED
    convs = placed.groupBy("conv").agg(F.lit(1).alias("_")).select("conv")
    wanted = convs.select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), h.alias("h"))
    heads = placed.where(F.col("place") < SHARED).withColumnRenamed("conv", "first")
    shared = wanted.join(heads, (F.col("base") == F.col("first")) & (F.col("place") <= F.col("h")))
    own = placed.where(F.col("place") > h)
    columns = ["place", "a", "b", "bytes"]
    turns = shared.select("conv", F.lit(0).alias("part"), *columns).union(
        own.select("conv", F.lit(1).alias("part"), *columns)
    )
    return turns, convs


# --------------------------------------------------------------------------- trie


def prefixes(turns: DataFrame, order: list[str]) -> DataFrame:
    """(conv, depth, n1, n2, q1, q2, bytes): each prefix's hash, and that of the prefix before.

    The hash of a prefix is the exclusive or of its turns' hashes, each of which holds the place.
    """
    numbered = place(turns, ["conv"], order)
    rows = numbered.running(numbered.rows, {"depth": Running("sum", "1")})
    rows = rows.withColumns(
        {"t1": F.xxhash64(F.lit(1), "depth", "a", "b"), "t2": F.xxhash64(F.lit(2), "depth", "b", "a")}
    )
    rolled = numbered.running(rows, {"n1": Running("xor", "t1"), "n2": Running("xor", "t2")})
    return rolled.select(
        "conv", F.col("depth").cast("long").alias("depth"), "n1", "n2",
        F.col("n1").bitwiseXOR(F.col("t1")).alias("q1"), F.col("n2").bitwiseXOR(F.col("t2")).alias("q2"),
        "bytes",
    )


def _meet(rows: DataFrame, table: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join with a table that has one row per key and, as ``weight``, the key's number of ``rows``.

    Rows of keys over ``HEAVY`` stay where they are: the few table rows they need are broadcast.
    """
    heavy = small(durable(table.where(F.col(weight) > HEAVY).drop(weight), "heavy-keys"))
    usual = rows.join(heavy.select(*on), on, "left_anti").join(
        table.where(F.col(weight) <= HEAVY).drop(weight), on, how
    )
    return usual.unionByName(rows.join(heavy, on))


def trie(
    turns: DataFrame, convs: DataFrame, order: list[str], most_local: int = MOST_LOCAL
) -> DataFrame:
    """One row per node of the trie of all conversations' prefixes.

    ``turns`` has (conv, a, b, bytes) and the columns to order by, ``convs`` every conversation once,
    also those without turns, all of which are members of the root. Columns: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. No
    conversations, no nodes.
    """
    paths = durable(prefixes(turns, order), "prefixes")
    lengths = paths.groupBy("conv").agg(F.max("depth").alias("length"))
    convs = durable(convs.join(lengths, "conv", "left").fillna(0, "length"), "conversations")
    zero = [F.lit(0).cast("long").alias(c) for c in ("n1", "n2", "q1", "q2")]
    inner = paths.groupBy("n1", "n2", "q1", "q2", "depth").agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.max("bytes").alias("bytes")
    )
    top = convs.select("conv", *zero).groupBy("n1", "n2", "q1", "q2").agg(
        F.lit(0).cast("long").alias("depth"), F.count("*").alias("n_convs"),
        F.min("conv").alias("conv"), F.lit(0).cast("long").alias("bytes"),
    )
    nodes = durable(inner.unionByName(top), "nodes")

    children = nodes.where("depth > 0").groupBy(F.col("q1").alias("n1"), F.col("q2").alias("n2"))
    nodes = nodes.join(children.agg(F.count("*").alias("n_children")), ["n1", "n2"], "left")
    nodes = durable(nodes.fillna(0, "n_children"), "nodes-and-children")
    parents = nodes.select(
        F.col("n1").alias("q1"), F.col("n2").alias("q2"), F.col("conv").alias("parent_conv_id"), "n_children"
    )
    below = nodes.where("depth > 0")
    named = _meet(below, parents.withColumnRenamed("n_children", "w"), ["q1", "q2"], "w")
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    named = named.unionByName(root).join(_sizes(paths, convs, nodes), ["n1", "n2"])
    named = named.join(_ends(paths, convs), ["n1", "n2"], "left").withColumns(
        {
            "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)),
            "leaf": (F.col("n_children") == 0).cast("long"),
            "saved": (F.col("n_convs") - 1) * F.col("bytes"),
        }
    )
    summed = rolled_up(named, paths, {"leaf": "n_leaves", "saved": "saved_tokens"}, most_local)
    return summed.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256",
    )


def _sizes(paths: DataFrame, convs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(n1, n2, size): nodes at or below each node; only the choice of centroids needs it.

    A node belongs to its smallest member, so a conversation's own nodes are the last ones of its
    path; each member of a node brings in those of its own nodes that are not above the node.
    """
    own = nodes.groupBy("conv").agg(F.min("depth").alias("own"))
    owners = durable(convs.join(own, "conv").withColumn("w", F.col("length")), "owners")
    root = owners.select(
        F.lit(0).cast("long").alias("n1"), F.lit(0).cast("long").alias("n2"), F.lit(0).alias("depth"), "own", "length"
    )
    met = _meet(paths.select("conv", "n1", "n2", "depth"), owners, ["conv"], "w")
    held = F.col("length") - F.greatest("depth", "own") + 1
    rows = met.select("n1", "n2", "depth", "own", "length").unionByName(root)
    return rows.groupBy("n1", "n2").agg(F.sum(held).alias("size"))


def _ends(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256): digest of the ids that end at a node, joined in order.

    Ids are sorted by range of (node, id) and joined in pieces there; a node's pieces then pass one
    task in order, which keeps only the digest, however many conversations end at the node.
    """
    closed = paths.select("conv", "n1", "n2", "depth").join(
        convs.where("length > 0").select("conv", F.col("length").alias("depth")), ["conv", "depth"]
    )
    zero = F.lit(0).cast("long")
    ends = closed.select("n1", "n2", "conv").unionByName(
        convs.where("length = 0").select(zero.alias("n1"), zero.alias("n2"), "conv")
    )
    ends = durable(ends, "ends")
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.repartitionByRange(n, "n1", "n2", "conv").sortWithinPartitions("n1", "n2", "conv")
    pieces = pieces.mapInArrow(_join_ids, "n1 long, n2 long, conv long, ids string")
    pieces = pieces.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "conv")
    return pieces.mapInArrow(_digest, "n1 long, n2 long, ends_sha256 string")


def _runs(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """Start and end of the rows of each node in a batch sorted by node."""
    if not batch.num_rows:
        return []
    n1, n2 = (batch.column(i).to_numpy() for i in (0, 1))
    new = np.flatnonzero((n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])) + 1
    edges = [0, *new.tolist(), batch.num_rows]
    return list(zip(edges[:-1], edges[1:]))


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    per = _CHUNK // 20  # a decimal long and its comma have at most 21 characters
    for batch in batches:
        convs = batch.column(2)
        ids = convs.cast(pa.string()).to_pylist()
        spans = [(i, min(i + per, b)) for a, b in _runs(batch) for i in range(a, b, per)]
        first = pa.array([a for a, _ in spans], pa.int64())
        yield pa.record_batch(
            [*(batch.column(i).take(first) for i in (0, 1)), convs.take(first),
             pa.array([",".join(ids[a:b]) for a, b in spans], pa.string())],
            names=["n1", "n2", "conv", "ids"],
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, last, digest = ["n1", "n2", "ends_sha256"], None, None
    for batch in batches:
        done = []
        for a, b in _runs(batch):
            node = batch.column(0)[a].as_py(), batch.column(1)[a].as_py()
            if node != last:
                if last is not None:
                    done.append((*last, digest.hexdigest()))
                last, digest, more = node, hashlib.sha256(), False
            for ids in batch.column(3).slice(a, b - a).to_pylist():
                digest.update(("," if more else "").encode() + ids.encode())
                more = True
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], names=names)
    if last is not None:
        yield pa.record_batch([pa.array([c]) for c in (*last, digest.hexdigest())], names=names)


# ------------------------------------------------------------------------- rollup


def rolled_up(
    nodes: DataFrame, paths: DataFrame, totals: dict[str, str], most_local: int = MOST_LOCAL
) -> DataFrame:
    """``nodes`` with, per ``value: name`` of ``totals``, the sum of the value over the subtree.

    ``nodes`` are (n1, n2, q1, q2, conv, depth, size, values..); ``paths`` give the node (n1, n2) at
    every depth of a conversation, and so any ancestor by one equal join. A component bears the name
    (c1, c2) of its top node; centroids leave the components, and their sums are complete.
    """
    spark = nodes.sparkSession
    zero = F.lit(0).cast("long")
    state = nodes.withColumns({"c1": zero, "c2": zero, **{n: zero for n in totals.values()}})
    state, path = durable_at(state, "components")
    settled = []
    while True:
        comps = state.where("c1 IS NOT NULL").groupBy("c1", "c2").agg(F.count("*").alias("n"))
        large, large_path = durable_at(comps.where(F.col("n") > most_local), "large-components")
        if large.isEmpty():
            settled.append(state)
            break
        large = small(large)
        settled.append(durable(state.join(large, ["c1", "c2"], "left_anti"), "settled-components"))
        state, next_path = durable_at(_split(state.join(large, ["c1", "c2"]), paths, totals), "components")
        forget(spark, path)
        forget(spark, large_path)
        path = next_path
    rest = settled[0]
    for more in settled[1:]:
        rest = rest.unionByName(more)
    return _finished(rest, totals)


def _split(rows: DataFrame, paths: DataFrame, totals: dict[str, str]) -> DataFrame:
    """One round: components of ``n`` nodes without their centroids, whose (c1, c2) become null."""
    by = ["c1", "c2"]
    lowest = F.min_by(F.struct("n1", "n2", "conv", "depth", "size"), "size").alias("x")
    centroids = rows.where("2 * size >= n").groupBy(*by).agg(lowest)
    centroids = small(durable(centroids.select(
        *by, F.col("x.n1").alias("x1"), F.col("x.n2").alias("x2"), F.col("x.conv").alias("x_conv"),
        F.col("x.depth").alias("x_depth"), F.col("x.size").alias("x_size"),
    ), "centroids"))
    rows = rows.join(centroids, by)

    # The way from a centroid up: the nodes of its conversation down to its depth, and the root.
    ends = ["c1", "c2", "x_conv", "x_depth"]
    way = paths.select(F.col("conv").alias("x_conv"), F.col("depth").alias("d"), "n1", "n2")
    way = centroids.select(*ends).join(way, "x_conv").where("d <= x_depth").select(*by, "n1", "n2")
    zero = F.lit(0).cast("long")
    way = way.union(centroids.select(*by, zero, zero)).withColumn("on_way", F.lit(True))
    rows = rows.join(way, [*by, "n1", "n2"], "left").fillna(False, "on_way")

    # The child of the centroid that lies on the way to a node is on its conversation's path.
    asked = rows.where("depth > x_depth").groupBy(*by, "conv", "x1", "x2", "x_depth").agg(F.count("*").alias("w"))
    under = paths.select(
        "conv", (F.col("depth") - 1).alias("x_depth"), F.col("n1").alias("k1"), F.col("n2").alias("k2"),
        F.col("q1").alias("x1"), F.col("q2").alias("x2"),
    )
    found = asked.join(under, ["conv", "x_depth", "x1", "x2"]).select(*by, "conv", "k1", "k2", "w")
    above = rows.where("depth <= x_depth").withColumns({k: F.lit(None).cast("long") for k in ("k1", "k2")})
    deep = _meet(rows.where("depth > x_depth"), durable(found, "under-centroids"), [*by, "conv"], "w", "left")
    marked = durable(above.unionByName(deep), "marked-nodes")

    is_x = (F.col("n1") == F.col("x1")) & (F.col("n2") == F.col("x2"))
    low = marked.where(is_x | F.col("k1").isNotNull()).groupBy(*by)
    low = low.agg(*[F.sum(value).alias(f"low {name}") for value, name in totals.items()])
    low = small(durable(low, "centroid-totals"))
    summed = marked.join(low, by)
    made = {
        name: F.col(name) + F.when(F.col("on_way"), F.col(f"low {name}")).otherwise(0)
        for name in totals.values()
    }
    made["size"] = F.col("size") - F.when(F.col("on_way") & ~is_x, F.col("x_size")).otherwise(0)
    for c, k in (("c1", "k1"), ("c2", "k2")):
        made[c] = F.when(~is_x, F.coalesce(F.col(k), F.col(c)))
    gone = ["n", "x1", "x2", "x_conv", "x_depth", "x_size", "on_way", "k1", "k2"]
    return summed.withColumns(made).drop(*gone, *[f"low {n}" for n in totals.values()])


def _finished(rows: DataFrame, totals: dict[str, str]) -> DataFrame:
    """The remaining components, each a bounded number of nodes, split to the end in tasks."""
    open_ones = rows.where("c1 IS NOT NULL").repartition("c1", "c2").sortWithinPartitions("c1", "c2", "depth")
    whole = open_ones.mapInArrow(lambda batches: _roll_up_batches(batches, totals), open_ones.schema)
    return whole.unionByName(rows.where("c1 IS NULL"))


def _roll_up_batches(
    batches: Iterator[pa.RecordBatch], totals: dict[str, str], rows: int = 50_000
) -> Iterator[pa.RecordBatch]:
    """Whole components at a time, some thousand rows of them."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        c1, c2 = (table.column(c).to_numpy() for c in ("c1", "c2"))
        last = np.flatnonzero((c1 != c1[-1]) | (c2 != c2[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from _roll_up(table.slice(0, cut), totals).to_batches()
        held = table.slice(cut).to_batches()
        size = table.num_rows - cut
    if size:
        yield from _roll_up(pa.Table.from_batches(held), totals).to_batches()


def _roll_up(table: pa.Table, totals: dict[str, str]) -> pa.Table:
    column = {c: table.column(c).to_numpy() for c in ("c1", "c2", "n1", "n2", "q1", "q2", "depth", "size")}
    values = np.stack([table.column(v).to_numpy() for v in totals])
    sums = component_sums(column, values)
    for i, name in enumerate(totals.values()):
        at = table.schema.get_field_index(name)
        table = table.set_column(at, table.schema.field(at), pa.array(table.column(name).to_numpy() + sums[i]))
    return table


def component_sums(column: dict[str, np.ndarray], values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over subtrees inside components; rows are sorted by component.

    All components are split at their centroids together, round by round. Nodes are numbered in
    preorder first, so that a subtree is a range of numbers.
    """
    n = len(column["n1"])
    new = np.ones(n, bool)
    new[1:] = (column["c1"][1:] != column["c1"][:-1]) | (column["c2"][1:] != column["c2"][:-1])
    comp = np.cumsum(new) - 1
    names = np.concatenate(
        [np.stack([column["n1"], column["n2"]], 1), np.stack([column["q1"], column["q2"]], 1)]
    )
    names = np.ascontiguousarray(names).view([("a", np.int64), ("b", np.int64)]).ravel()
    found, place = np.unique(names, return_inverse=True)
    slot = np.full(len(found), -1)
    slot[place[:n]] = np.arange(n)
    parent = slot[place[n:]]
    parent[(parent == np.arange(n)) | (comp[parent] != comp)] = -1

    size = column["size"].astype(np.int64)
    start = _preorder(comp, parent, column["depth"], size, new)
    end = start + size
    label, here, alive = comp.copy(), size.copy(), np.arange(n)
    sums = np.zeros_like(values)
    while len(alive):
        _, own = np.unique(label[alive], return_inverse=True)
        half = np.flatnonzero(2 * here[alive] >= np.bincount(own)[own])
        half = half[np.lexsort((here[alive[half]], own[half]))]
        _, first = np.unique(own[half], return_index=True)
        x = alive[half[first]]  # the centroid of every component
        of = x[own]
        at = start[alive]
        low = (at >= start[of]) & (at < end[of])
        way = (at <= start[of]) & (start[of] < end[alive])
        for i in range(len(values)):
            gathered = np.zeros(len(x), values.dtype)
            np.add.at(gathered, own[low], values[i, alive[low]])
            sums[i, alive[way]] += gathered[own[way]]
        below, above = low & (alive != of), way & (alive != of)
        taken = here[of[above]]
        here[alive[above]] -= taken
        tops = np.flatnonzero(below & (parent[alive] == of))
        keys = own[tops] * n + at[tops]
        tops = tops[np.argsort(keys)]
        under = np.searchsorted(np.sort(keys), own[below] * n + at[below], side="right") - 1
        label[alive[below]] = n + alive[tops[under]]
        alive = alive[alive != of]
    return sums


def _preorder(comp, parent, depth, size, new) -> np.ndarray:
    """Numbers of the nodes, from 0 over all components, with every subtree in one piece."""
    by_parent = np.lexsort((np.arange(len(parent)), parent))
    sizes = size[by_parent]
    before = np.cumsum(sizes) - sizes
    first = np.ones(len(parent), bool)
    first[1:] = parent[by_parent][1:] != parent[by_parent][:-1]
    group = np.cumsum(first) - 1
    offset = np.empty(len(parent), np.int64)
    offset[by_parent] = before - before[first][group]
    start = np.zeros(len(parent), np.int64)
    tops = np.flatnonzero(parent < 0)
    start[tops] = np.flatnonzero(new)[comp[tops]]
    rest = np.flatnonzero(parent >= 0)
    rest = rest[np.argsort(depth[rest], kind="stable")]
    edges = np.flatnonzero(np.diff(depth[rest])) + 1
    for level in np.split(rest, edges):
        start[level] = start[parent[level]] + 1 + offset[level]
    return start


def shared_prefixes(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    most_local: int = MOST_LOCAL,
) -> DataFrame:
    """The trie of conversations rebuilt with their family's first turns (see ``rebuilt``, ``trie``).

    Null turn numbers come first, ties go by role and text, repeated rows are turns, null roles and
    texts are empty, rows without a conversation id are left out; an empty table has no nodes; other
    columns are not read.
    """
    placed = durable(placed_turns(turns, conv, turn, role, text), "placed-turns")
    made, convs = rebuilt(placed)
    return trie(made, convs, ["part", "place"], most_local)
