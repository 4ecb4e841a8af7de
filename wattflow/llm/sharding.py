"""Sharding by balanced label propagation.

Linked documents are nodes of bonds (a bond holds any number of nodes: the
copies of one text, or the two ends of an edge).  Every linked node begins at a
shard of its hash.  In each round a node looks at how many of its neighbours
stand in each shard, by joins over per-bond tallies, and asks to move to the
one with most.  What flows from shard to shard is cut to quotas under which no
shard passes its capacity; whole bonds go first.  A bond that does not fit into
one shard so fills one after another.

Documents without links cut no edge wherever they go, so they are dealt last,
from large to small, into what room is left, which evens out the sizes.  Only
figures per shard, and quotas per pair of shards, reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattflow.llm.common import attach, cut, whole_text

SHARDS = 8
ROUNDS = 12
# A shard counts as full from this part of its capacity on.
FULL = 0.98
# The part of an even share that linked nodes leave free, so that there is something to even out with,
# and by how much they may pass their own mean where nearly everything is linked.
RESERVE = 0.01
SLACK = 0.05
# Parts that the movers of a pair of shards are dealt to by bond, to take whole bonds first.
PARTS = 1024
# Rows of a bucket in which positions are counted, about, and the least number of buckets.
BUCKET_ROWS = 65_536
BUCKETS = 64
# Unlinked nodes are placed in classes: at least this part of an even share each, large ones first.
SIZE_CLASSES = (1 / 64, 1 / 256, 1 / 1024, 1 / 4096, 1 / 16384, 0)


def bonds_of_edges(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, bond) of a table of edges; loops and null ends are left out, repeated edges count once."""
    ends = (edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
            .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    return ends.select(F.explode(F.array("u", "v")).alias("node"), F.xxhash64("u", "v").alias("bond"))


def _loads(state: DataFrame, shards: int) -> np.ndarray:
    load = np.zeros(shards)
    for r in state.groupBy("shard").agg(F.sum("size").alias("size")).collect():
        load[r.shard] = r.size
    return load


def _quotas(wanted: np.ndarray, load: np.ndarray, cap: float) -> np.ndarray:
    """How much may flow from shard to shard: ``wanted``, scaled down until no shard passes
    its capacity (or, if it is over it now, grows)."""
    flow, most = wanted.copy(), np.maximum(load, cap)
    for _ in range(1000):
        into = flow.sum(0)
        room = np.maximum(most - load + flow.sum(1), 0)
        over = into > room * (1 + 1e-9)
        if not over.any():
            break
        flow[:, over] *= (room[over] / into[over])[None, :]
    return flow


def _shares(movers: DataFrame, by: list[str], quota: Column) -> DataFrame:
    """(by..., part, mass, share): of the movers dealt to a part, the share within the quota; small parts first.
    Has at most one row for each of ``by`` and PARTS."""
    parts = movers.groupBy(*by, "part").agg(F.sum("size").alias("mass"))
    before = F.sum("mass").over(Window.partitionBy(*by).orderBy("mass", "part")) - F.col("mass")
    return parts.select(*by, "part", "mass", F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), (quota - before) / F.col("mass"))).alias("share"))


def _within(share: Column, step: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit("share"), F.lit(step)), F.lit(1 << 20)) < F.ceil(share * (1 << 20))


def _array_at(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), at)


def propagate(nodes: DataFrame, bonds: DataFrame, shards: int, cap: float, rounds: int = ROUNDS) -> DataFrame:
    """(node, size, tie, part, shard) of the linked ``nodes`` (node, size) after label propagation over ``bonds``.

    A node of several bonds adds up its neighbours in all of them.  Of equally
    good shards that nearest after the bond's own (by hash) is taken, the same
    for all nodes of a bond; from the third round on half of the nodes, by hash,
    wait, so that neighbours do not swap for ever.
    """
    tie = bonds.groupBy("node").agg(F.min(F.xxhash64("bond")).alias("tie"))
    state = cut(nodes.join(tie, "node").select(
        "node", "size", "tie", F.pmod(F.col("tie"), F.lit(PARTS)).cast("int").alias("part"),
        F.pmod(F.xxhash64("node", F.lit("start")), F.lit(shards)).cast("int").alias("shard")), "labels")
    for step in range(rounds):
        load = _loads(state, shards)
        placed = bonds.join(state.select("node", "shard"), "node")
        tally = placed.groupBy("bond").agg(F.count(F.lit(1)).alias("n"), *[
            F.count_if(F.col("shard") == s).alias(f"c{s}") for s in range(shards)])
        votes = (attach(placed.select("node", "bond"), tally, "bond", "n", ["node"]).groupBy("node")
                 .agg(F.count(F.lit(1)).alias("bonds"), *[F.sum(f"c{s}").alias(f"c{s}") for s in range(shards)]))
        # a node counts once for the shard it stands in, not in each of its bonds; no one asks for a full shard
        choices = F.array(*[F.when(F.lit(bool(load[s] < FULL * cap)) | (F.col("shard") == s), F.struct(
            (F.when(F.col("shard") == s, F.col("bonds") - 1).otherwise(0) - F.col(f"c{s}")).alias("votes"), F.pmod(F.lit(s) - F.col("tie"), F.lit(shards)).alias("far"),
            F.lit(s).alias("s"))) for s in range(shards)])
        asked = cut(state.join(votes, "node").withColumn("to", F.array_min(F.array_compact(choices))["s"])
                    .select(*state.columns, F.when(
                        F.lit(step < 2) | (F.pmod(F.xxhash64("node", F.lit(step)), F.lit(2)) == 0),
                        F.col("to")).otherwise(F.col("shard")).alias("to")), "asked")
        movers = asked.filter("to <> shard")
        wanted = np.zeros((shards, shards))
        for r in movers.groupBy("shard", "to").agg(F.sum("size").alias("size")).collect():
            wanted[r.shard, r.to] = r.size
        if not wanted.any():
            if step < 2 or step == rounds - 1:
                break
            continue
        quota = _array_at(_quotas(wanted, load, cap).ravel().tolist(), F.col("shard") * shards + F.col("to") + 1)
        share = _shares(movers, ["shard", "to"], quota)
        moves = F.col("share").isNotNull() & _within(F.col("share"), step)
        state = cut(asked.join(F.broadcast(share), ["shard", "to", "part"], "left").select(
            "node", "size", "tie", "part", F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("shard")), "labels")
    return state


def _level(load: np.ndarray, mass: float) -> float:
    """The height to which ``mass`` more fills shards of these loads."""
    height = np.sort(load)
    for i in range(len(height)):
        level = (mass + height[:i + 1].sum()) / (i + 1)
        if i + 1 == len(height) or level <= height[i + 1]:
            return level
    return 0.0


def _order() -> Column:
    return F.xxhash64("node", F.lit("position"))


def _positions(rows: DataFrame, by: str, amount: str, n_rows: int) -> DataFrame:
    """``rows`` with ``before``: the sum of ``amount`` over the rows of the same ``by`` that stand earlier,
    by ``order`` (a hash). Buckets are summed first, so that no task sees all rows of one ``by``."""
    buckets = max(BUCKETS, n_rows // BUCKET_ROWS)
    dealt = rows.withColumn("_bucket", F.pmod("order", F.lit(buckets)).cast("int"))
    sums = dealt.groupBy(by, "_bucket").agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(by, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(by, "_bucket").orderBy("order", "node")
    return (dealt.withColumn("_upto", F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
            .join(sums, [by, "_bucket"])
            .withColumn("before", F.col("_base") + F.col("_upto") - F.col(amount))
            .drop("order", "_bucket", "_upto", "_base"))


def _release(labels: DataFrame, load: np.ndarray, level: float) -> tuple[DataFrame, DataFrame]:
    """Of linked nodes: those that stay, and those that leave shards above the level, small bonds first.

    Those that leave carry the ``order`` in which they are dealt anew: the nodes of a small bond in a row.
    """
    quota = _array_at(np.maximum(load - level, 0).tolist(), F.col("shard") + 1)
    over = [s for s in range(len(load)) if load[s] > level]
    share = _shares(labels.filter(F.col("shard").isin(over)), ["shard"], quota)
    marked = cut(labels.join(F.broadcast(share), ["shard", "part"], "left").withColumn(
        "leaves", F.col("share").isNotNull() & _within(F.col("share"), -1)), "released")
    small = (F.col("share") == 1) & (F.col("mass") < 8 * level / PARTS)
    order = F.when(small, F.xxhash64("tie", F.lit("position"))).otherwise(_order())
    return (marked.filter("not leaves").select("node", "size", "shard"),
            marked.filter("leaves").select("node", "size", order.alias("order")))


def assign(nodes: DataFrame, bonds: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS,
           reserve: float = RESERVE) -> DataFrame:
    """(node, size, shard) of all ``nodes`` (node: distinct, size: positive), sizes near equal.

    ``bonds`` (node, bond) say which nodes want to stand together.  Shards
    differ by a few small nodes, or by as much as single nodes force.
    """
    n_rows, total = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    even = total / shards
    linked = bonds.select("node").distinct().withColumn("linked", F.lit(True))
    marked = cut(nodes.join(linked, "node", "left").select("node", "size", F.col("linked").isNotNull().alias("linked")),
                 "nodes")
    mass = marked.filter("linked").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cap = max((1 - reserve) * even, (1 + SLACK) * mass / shards)
    labels = propagate(marked.filter("linked").drop("linked"), bonds, shards, cap, rounds)
    free = marked.filter("not linked").select("node", "size", _order().alias("order"))
    load = _loads(labels, shards)
    level = _level(load, total - load.sum())
    settled = labels.select("node", "size", "shard")
    if load.max() > level * (1 + 1e-9):
        settled, released = _release(labels, load, level)
        free, load = free.unionByName(released), _loads(settled, shards)
    kind = F.lit(len(SIZE_CLASSES) - 1)
    for c, part in reversed(list(enumerate(SIZE_CLASSES[:-1]))):
        kind = F.when(F.col("size") >= part * even, F.lit(c)).otherwise(kind)
    placed = cut(_positions(free.withColumn("kind", kind), "kind", "size", n_rows), "positions")
    mass = {r.kind: r.size for r in placed.groupBy("kind").agg(F.sum("size").alias("size")).collect()}
    done = [settled]
    for c in range(len(SIZE_CLASSES)):
        if c not in mass:
            continue
        ends = np.cumsum(np.maximum(_level(load, mass[c]) - load, 0))
        middle = F.col("before") + F.col("size") / 2
        shard = F.lit(shards - 1)
        for s in reversed(range(shards - 1)):
            shard = F.when(middle < float(ends[s]), F.lit(s)).otherwise(shard)
        some = placed.filter(F.col("kind") == c).select("node", "size", shard.alias("shard"))
        load = load + _loads(some, shards)
        done.append(some)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
          rounds: int = ROUNDS, reserve: float = RESERVE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    Size is the UTF-8 bytes of the text and 1; rows of equal texts are linked
    (null counts as empty).  The law is ``bytes``: shards have nearly the same
    sum of sizes; copies stay together as far as a shard holds them.  ``slot``
    counts the rows of a shard from 0 without gaps; ``grown_shard`` belongs to
    another law and is null.  Null ids and repeated rows are rows like any
    other; other columns are ignored; an empty table gives no rows.  Which of
    the even layouts is found depends on how the table is cut into files; the
    numbering of rows is written to the shared folder first, so a lost executor
    does not change it.
    """
    text = whole_text(F.col(text_col))
    rows = cut(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text)).alias("bond"),
        F.monotonically_increasing_id().alias("node")), "rows")
    copies = rows.groupBy("bond").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("copies", F.col("n"))
    bonds = cut(attach(rows.select("node", "bond"), copies, "bond", "n", ["node"])
                .filter(F.col("copies").isNotNull()).select("node", "bond"), "bonds")
    labels = assign(rows.select("node", "size"), bonds, shards, rounds, reserve)
    out = rows.drop("bond").join(labels.select("node", "shard"), "node").withColumns({"one": F.lit(1), "order": _order()})
    slots = _positions(cut(out, "sharded"), "shard", "one", rows.count())
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                        F.col("before").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
