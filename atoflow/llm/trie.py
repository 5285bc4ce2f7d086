"""Prefix trie of conversations, its subtree totals added up by a centroid decomposition.

Turns are replaced by digests, so texts are not shuffled.  Every prefix of a conversation has an
additive hash (sum of digest times base to the power of the depth, in two bases), so that the hash of
its parent follows by subtraction and conversations that lie over several tasks are added up from the
tasks' sums.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atoflow.llm.common import SPACE_CLASS, shared_table
from atoflow.llm.ranges import digests

MODULUS = (1 << 61) - 1
BASES = (911_382_323_717_171, 1_972_663_111_939_393)
#: Components of at most so many nodes are decomposed inside one task.
SMALL = 4096
#: Most large components whose centroids and totals are broadcast (some MB).
BROADCAST = 100_000
#: Parts over which the nodes of one large component are dealt in a join.
SALT = 32
#: Columns that name a node, and the top of its component.
KEY, TOP = ["d", "x", "y"], ["top_d", "top_x", "top_y"]


def token(role: Column, text: Column) -> list[Column]:
    """Columns a, b, words of a turn: two numbers from the SHA-256 of role and text, and its number of words."""
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    number = lambda at: (F.conv(F.substring(sha, at, 15), 16, 10).cast("long") + 1)
    return [number(1).alias("a"), number(16).alias("b"),
            F.size(F.array_remove(F.split(text, SPACE_CLASS + "+"), "")).cast("long").alias("words")]


def _times(value: Column, factor: Column, more: Column) -> Column:
    """``(value * factor + more) % MODULUS``: a product of two 61-bit numbers fits a decimal."""
    wide = lambda c: c.cast("decimal(20,0)")
    return ((wide(value) * wide(factor) + wide(more)) % F.lit(MODULUS).cast("decimal(20,0)")).cast("long")


def shifted(value: Column, places: Column, base: int, more: Column) -> Column:
    """A sum of hashes moved to depths less by ``places`` (0 to 3), plus the hash ``more``; ``value`` may be below zero."""
    m = MODULUS
    back = F.get(F.array(*(F.lit(pow(base, -n, m)) for n in range(4))), places.cast("int"))
    return F.when(places == 0, F.pmod(value + more, F.lit(m))).otherwise(_times(F.pmod(value, F.lit(m)), back, more))


def prefixes(turns: DataFrame, id_col: str, turn_col: str) -> DataFrame:
    """``id_col, d, words, x, y, px, py, last``: the place d (from 1) of each turn by number, null first, equal ones
    by digest, the hash of the first d turns and of the first d-1, and whether the turn is its conversation's last.

    The turns are dealt by ranges, so that a long conversation lies in several, and no task keeps more
    than a batch.  Places and hashes are counted within a range first (:func:`_before` has the rest).
    """
    by = [F.col(c).asc_nulls_first() for c in (id_col, turn_col, "a", "b")]
    flat = turns.select(id_col, turn_col, "a", "b", "words").repartitionByRange(*by).sortWithinPartitions(*by).select(id_col, "a", "b", "words")
    m, (base_x, base_y) = MODULUS, BASES
    names = [id_col, "at", "words", "x", "y", "px", "py", "last", "edge", "p"]

    def run(batches):
        p, now, first, rows = TaskContext.get().partitionId(), None, True, []

        def table(done):
            cols = list(zip(*done))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), *(pa.array(c, pa.bool_()) for c in cols[7:]),
                                               pa.array([p] * len(done), pa.int64())], names=names)

        for b in batches:
            for key, a, b_, n in zip(*(c.to_pylist() for c in b.columns)):
                if key != now:
                    if rows:
                        rows[-1][7:] = True, first
                        first = False
                    now, at, x, y, fx, fy = key, 0, 0, 0, 1, 1
                at, fx, fy, px, py = at + 1, fx * base_x % m, fy * base_y % m, x, y
                x, y = (x + a * fx) % m, (y + b_ * fy) % m
                rows.append([key, at, n, x, y, px, py, False, False])
            # whether a row is the last of its key shows at the next one
            if len(rows) > 1:
                yield table(rows[:-1])
                rows = rows[-1:]
        if rows:
            rows[-1][7:] = True, True
            yield table(rows)

    kind = turns.schema[id_col].dataType.simpleString()
    cut = shared_table(flat.withColumn(id_col, F.col(id_col).cast("long")).mapInArrow(
        run, f"`{id_col}` long, " + ", ".join(f"{c} long" for c in names[1:7]) + ", last boolean, edge boolean, p long"), "trie")
    cut = cut.join(_before(cut, id_col), [id_col, "p"], "left")
    whole = lambda c, v: F.when(F.col("n").isNull(), F.col(c)).otherwise(_times(F.col(c), F.col(f"f{v}"), F.col(f"b{v}"))).alias(c)
    return cut.select(F.col(id_col).cast(kind).alias(id_col), (F.col("at") + F.coalesce("n", F.lit(0))).cast("long").alias("d"), "words",
                      whole("x", "x"), whole("y", "y"), whole("px", "x"), whole("py", "y"),
                      (F.col("last") & ~F.coalesce("later", F.lit(False))).alias("last"))


def _before(cut: DataFrame, key: str) -> DataFrame:
    """Of each key that lies in several ranges ``p``: number of rows and hashes of the earlier ranges, the factors
    that move a range's own hashes behind them, and whether a later range follows.

    Only the first and the last key of a range can lie in others, so there are at most two rows a
    range: small enough for the driver and a broadcast, whatever the table's size.
    """
    parts = defaultdict(list)
    for k, *row in cut.filter("edge").select(key, "p", "at", "x", "y").collect():
        parts[k].append(row)
    m, out = MODULUS, []
    for k, rows in parts.items():
        n, x, y = 0, 0, 0
        for i, (p, at, own_x, own_y) in enumerate(sorted(rows)):
            fx, fy = (pow(base, n, m) for base in BASES)
            if len(rows) > 1:
                out.append((k, p, n, x, y, fx, fy, i + 1 < len(rows)))
            n, x, y = n + at, (x + own_x * fx) % m, (y + own_y * fy) % m
    names = [key, "p", "n", "bx", "by", "fx", "fy", "later"]
    table = pa.table([pa.array([r[i] for r in out], pa.bool_() if c == "later" else pa.int64()) for i, c in enumerate(names)], names=names)
    return F.broadcast(cut.sparkSession.createDataFrame(table))


def _rooted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` of :func:`prefixes` and the textless prefix (d = 0) of every conversation."""
    zero = [F.lit(0).cast("long").alias(c) for c in ("d", "words", "x", "y")]
    none = [F.lit(None).cast("long").alias(c) for c in ("px", "py")]
    some = rows.filter("d = 1").select("conv_id", F.lit(False).alias("last"))
    return rows.unionByName(ids.distinct().join(some, "conv_id", "left").select(
        "conv_id", *zero, *none, F.coalesce("last", F.lit(True)).alias("last")))


def prefix_trie(turns: DataFrame, ids: DataFrame, small: int = SMALL) -> DataFrame:
    """One row per node of the trie of the conversations' first d turns, the textless root included.

    ``turns(conv_id long, d, a, b, words)`` are digests of turns (:func:`token`), numbered from 1
    without holes; ``ids(conv_id)`` all conversations, also those without turns.  Turns that have the
    hashes of their prefixes already (columns of :func:`prefixes`) bring the textless prefixes, d = 0,
    with them, and ``ids`` are not read.
    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root: null), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.  Repeated ids count once; no
    conversations give no rows.

    The parent edges form a tree.  Its node counts come from the members: a conversation owns the
    nodes whose smallest member it is, the deepest of its own, so a node has below it what its members
    own, but for its own smallest member's shallower nodes.  With them :func:`rollup` decomposes the tree.
    """
    rows = shared_table(turns if "px" in turns.columns else _rooted(prefixes(turns, "conv_id", "d"), ids), "trie")
    held = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id")).groupBy("conv_id").agg(
        F.count("*").alias("own"), F.min("d").alias("first"))
    nodes = shared_table(rows.join(held, "conv_id", "left").groupBy(*KEY).agg(
        F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
        F.any_value("px").alias("px"), F.any_value("py").alias("py"), F.sum("own").alias("below"),
        F.min_by("first", "conv_id").alias("first"), F.min(F.col("last").cast("long")).alias("leaves")).select(
        *KEY, "px", "py", "rep", "n_convs", (F.col("below") - F.col("d") + F.col("first")).cast("long").alias("size"), "leaves",
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "trie")
    totals = rollup(nodes.drop("n_convs"), rows, small)
    sha = _ends(rows.filter("last"))
    children = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("px").alias("x"), F.col("py").alias("y")).agg(
        F.count("*").alias("n_children"))
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("rep").alias("parent_rep"))
    return nodes.select(*KEY, "px", "py", "rep", "n_convs").join(totals, KEY).join(children, KEY, "left").join(sha, KEY, "left").join(
        parents, ["d", "px", "py"], "left").select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.col("parent_rep").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _ends(last: DataFrame) -> DataFrame:
    """``d, x, y, digest``: SHA-256 of the ids of the conversations that end at a node, ascending and comma-joined.

    Dealt by ranges of node and id, and cut by places in them: a node's ids lie in any number of
    ranges, in pieces of at most 1 024.
    """
    by = ["k", "conv_id"]
    # ids differ, so a range that is made again has the same order
    cut = last.select(F.concat_ws(":", *KEY).alias("k"), "conv_id").repartitionByRange(*by).sortWithinPartitions(*by).withColumn(
        "seg", F.shiftright(F.monotonically_increasing_id(), 10))
    pieces = cut.groupBy("k", "seg").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("text"))
    return digests(pieces, "k", ["seg"], "text", ",").select("digest", *(F.split("k", ":")[i].cast("long").alias(c) for i, c in enumerate(KEY)))


def rollup(nodes: DataFrame, steps: DataFrame, small: int = SMALL) -> DataFrame:
    """Sums of ``leaves`` and ``saved`` over each node's subtree: ``d, x, y, leaves, saved``.

    ``nodes(d, x, y, px, py, rep, size, leaves, saved)`` with the subtree's number of nodes;
    ``steps(conv_id, d, x, y, px, py)`` names the node that each conversation passes at each depth.

    Centroid decomposition: a component's nodes with over half of it below them are a path from its
    top, and the last of them is the centroid.  What lies in the component at and under the centroid
    is totalled once and added to every node of that path; the centroid goes, and its children's
    subtrees and the rest above are components of at most half the size.  Larger components take one
    round per halving; those of at most ``small`` nodes are set aside and all finished together, one
    task each, by the same method.  A node's component below a centroid is named by the centroid's
    child, which the path of the node's own smallest member passes.
    """
    root = nodes.filter("d = 0").select("size").first()
    if root is None:
        return nodes.select(*KEY, "leaves", "saved")
    zero = F.lit(0).cast("long")
    state = nodes.select("*", *(zero.alias(c) for c in TOP), F.lit(root.size).alias("n"), zero.alias("got_leaves"), zero.alias("got_saved"))
    settled, aside = [], []
    more = root.size > small
    while more:
        gone, state = _round(state, steps, small, root.size // small)
        settled.append(gone)
        aside.append(state.filter(F.col("n") <= small))
        state = state.filter(F.col("n") > small)
        more = not state.isEmpty()
    out = _finished(reduce(DataFrame.unionByName, aside) if aside else state)
    return reduce(DataFrame.unionByName, settled, out)


def _per_component(rows: DataFrame, info: DataFrame, most: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``info(*TOP, ...)``, at most ``most`` rows.

    There are few large components, so that ``info`` is broadcast; of more than ``BROADCAST``, a
    component's rows are dealt over ``SALT`` parts.
    """
    if most <= BROADCAST:
        return rows.join(F.broadcast(info), TOP, how)
    salted = info.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*KEY), F.lit(SALT))).join(salted, [*TOP, "salt"], how).drop("salt")


def _round(state: DataFrame, steps: DataFrame, small: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Takes the centroid out of each component, of which there are at most ``most``: (totals of the centroids,
    state of the new components).  The size ``n`` of a new component of at most ``small`` nodes may read 0."""
    on_path = F.col("size") * 2 > F.col("n")
    # sizes fall along a path, so the smallest is one node's
    centre = state.filter(on_path).groupBy(*TOP).agg(*(F.min_by(c, "size").alias(f"c_{c}") for c in KEY), F.min("size").alias("c_size"))
    rows = _per_component(state, centre, most)
    # the node itself is looked up where it is not deeper than the centroid: every row finds one step
    passed = steps.select(F.col("conv_id").alias("rep"), F.col("d").alias("at"), *(F.col(c).alias(f"s_{c}") for c in ("x", "y", "px", "py")))
    rows = rows.withColumn("at", F.least(F.col("c_d") + 1, F.col("d"))).join(passed, ["rep", "at"])
    rows = shared_table(rows.withColumn("centre", (F.col("d") == F.col("c_d")) & (F.col("x") == F.col("c_x")) & (F.col("y") == F.col("c_y"))).withColumn(
        "under", (F.col("d") > F.col("c_d")) & (F.col("s_px") == F.col("c_x")) & (F.col("s_py") == F.col("c_y"))), "trie")
    total = rows.filter("centre or under").groupBy(*TOP).agg(F.sum("leaves").alias("t_leaves"), F.sum("saved").alias("t_saved"))
    # only the large ones among the centroids' children need their size told to the nodes below
    large = rows.filter(F.col("under") & (F.col("at") == F.col("d")) & (F.col("size") > small)).select(
        *(F.col(c).alias(t) for c, t in zip(KEY, TOP)), F.col("size").alias("large"))
    rows = _per_component(rows, total, most)
    for v in ("leaves", "saved"):
        rows = rows.withColumn(f"got_{v}", F.col(f"got_{v}") + F.when(on_path, F.col(f"t_{v}")).otherwise(0))
    under = F.coalesce("under", F.lit(False))
    rows = rows.withColumn("size", F.when(on_path & ~F.col("centre"), F.col("size") - F.col("c_size")).otherwise(F.col("size"))).withColumn(
        "n", F.col("n") - F.col("c_size"))
    for t, s in zip(TOP, ("at", "s_x", "s_y")):
        rows = rows.withColumn(t, F.when(under, F.col(s)).otherwise(F.col(t)))
    rows = _per_component(rows, large, most, "left").withColumn("n", F.when(under, F.coalesce("large", F.lit(0))).otherwise(F.col("n")).cast("long"))
    rows = shared_table(rows.select(*KEY, "px", "py", "rep", "size", "leaves", "saved", *TOP, "n", "got_leaves", "got_saved", "centre"), "trie")
    return (rows.filter("centre").select(*KEY, F.col("got_leaves").alias("leaves"), F.col("got_saved").alias("saved")),
            rows.filter("not centre").drop("centre"))


def decompose(size: list[int], parent: list[int], leaves: list[int], saved: list[int]) -> tuple[list[int], list[int]]:
    """Subtree sums of one component by its centroids; node 0 is the top, ``parent`` its nodes' places (top: -1)."""
    size, below = list(size), [[] for _ in size]
    for v, p in enumerate(parent):
        if p >= 0:
            below[p].append(v)
    got_leaves, got_saved = [0] * len(size), [0] * len(size)
    tops = [0]
    while tops:
        top = tops.pop()
        n, path = size[top], [top]
        while True:
            heavy = next((v for v in below[path[-1]] if size[v] * 2 > n), None)
            if heavy is None:
                break
            path.append(heavy)
        centre, total_leaves, total_saved = path[-1], 0, 0
        under = [centre]
        for v in under:
            total_leaves += leaves[v]
            total_saved += saved[v]
            under.extend(below[v])
        for v in path:
            got_leaves[v] += total_leaves
            got_saved[v] += total_saved
        tops.extend(below[centre])
        if centre != top:
            for v in path[:-1]:
                size[v] -= size[centre]
            below[path[-2]].remove(centre)
            tops.append(top)
        below[centre] = []
    return got_leaves, got_saved


def _finished(state: DataFrame) -> DataFrame:
    """Totals of the nodes of small components, each component decomposed where its rows are."""
    cols = [*TOP, *KEY, "px", "py", "size", "leaves", "saved", "got_leaves", "got_saved"]
    rows = state.select(*cols).repartition(*TOP).sortWithinPartitions(*TOP, *KEY)
    names = [*KEY, "leaves", "saved"]

    def close(held):
        place = {row[3:6]: i for i, row in enumerate(held)}
        parent = [-1 if i == 0 else place[r[3] - 1, r[6], r[7]] for i, r in enumerate(held)]
        more = decompose([r[8] for r in held], parent, [r[9] for r in held], [r[10] for r in held])
        return [(*r[3:6], r[11] + a, r[12] + b) for r, a, b in zip(held, *more)]

    def run(batches):
        now, held = None, []
        table = lambda out: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:3] != now:
                    if held:
                        out.extend(close(held))
                    now, held = row[:3], []
                held.append(row)
            if out:
                yield table(out)
        if held:
            yield table(close(held))

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))
