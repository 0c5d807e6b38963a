"""Connected components and communities of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import drop_tables, ship, write_table, written

#: A move must gain more than what sums of doubles may be off by.
GAIN = 1e-12
#: Moves at a community are ranked by so many steps to every doubling of the gain, and by so many hash values within a step.
STEPS, SPREAD = 16, 64
#: Links, in both directions, whose communities one task finds by itself: some 200 bytes each while it does.
WHOLE = 1 << 20


def components(edges: DataFrame, a: str = "a", b: str = "b", least: int = 1) -> DataFrame:
    """(node, component) of every node of ``edges`` in a component of at least ``least`` nodes; its name is its smallest node.

    Each round takes the smallest label among a node's neighbours, then follows labels once, and
    writes the labels, so that neither lineage nor anything on the driver grows.  Rows with a null
    end are ignored; a self edge makes its node a component of its own.  Labels are brought to edges by a join of
    two written tables, which adaptive execution splits where a hub's edges make a partition hot, and
    are aggregated map-side after it, so a star of any size costs one row a task from there on.
    """
    clean = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    both = write_table(clean.union(clean.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("lower"))
        above = labels.select(F.col("node").alias("lower"), F.col("component").alias("jump"))
        moved = write_table(lower.join(above, "lower").select("node", F.col("component").alias("was"), F.least("lower", "jump").alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.where(F.col("was") != F.col("component")).isEmpty():
            break
    if least < 2:
        return labels
    large = labels.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("component")
    return labels.join(large, "component", "left_semi").select("node", "component")


def degree(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, degree): the distinct edges at each node, whichever end it is."""
    pairs = edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x <> y").distinct()
    return pairs.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def in_threes(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The ``edges`` in components of three nodes or more: those with an end that has another neighbour as well.  Self edges and null ends are left out."""
    more = write_table(degree(edges, a, b).where("degree > 1").select("node"), "in_threes")
    of_a, of_b = (more.select(F.col("node").alias(c), F.lit(True).alias(f"__{x}")) for c, x in ((a, "a"), (b, "b")))
    return edges.where(F.col(a) != F.col(b)).join(of_a, a, "left").join(of_b, b, "left").where("__a OR __b").select(edges.columns)


def links_of(edges: DataFrame, a: str = "a", b: str = "b", weight: str | None = None) -> DataFrame:
    """(i, j, w) in both directions: parallel edges added up, self edges, null ends and weights not above 0 left out."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    one = edges.select(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"), w.alias("w")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("i") != F.col("j")) & (F.col("w") > 0))
    one = one.groupBy("i", "j").agg(F.sum("w").alias("w"))
    return one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def modularity(links: DataFrame, groups: DataFrame) -> float:
    """The modularity of ``groups`` (node, community) over ``links``: the share of weight inside, less what chance would put there."""
    of = groups.select(F.col("node").alias("i"), F.col("community").alias("ci"))
    to = groups.select(F.col("node").alias("j"), F.col("community").alias("cj"))
    met = links.join(of, "i").join(to, "j").groupBy("ci").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w")).otherwise(0.0)).alias("inside"))
    found = met.agg(F.sum("k").alias("all"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("squares")).first()
    return found.inside / found.all - found.squares / found.all**2 if found.all else 0.0


def _moves(links: DataFrame, state: DataFrame, all_: float, turn: int) -> tuple[DataFrame, bool]:
    """(the moves (i, to) that are safe together, whether any node gains by a move at all)."""
    to = state.select(F.col("i").alias("j"), F.col("c").alias("to"))
    toward = links.where("i <> j").join(to, "j").groupBy("i", "to").agg(F.sum("w").alias("w"))
    sums = state.groupBy("c").agg(F.sum("k").alias("sum"))
    own = state.join(sums, "c").select("i", "k", F.col("c").alias("own"), F.col("sum").alias("own_sum"))
    near = toward.join(own, "i").join(sums.select(F.col("c").alias("to"), F.col("sum").alias("to_sum")), "to")
    stay = near.where(F.col("to") == F.col("own")).select("i", F.col("w").alias("stay"))
    away = near.where(F.col("to") != F.col("own")).join(stay, "i", "left")
    gain = 2 * ((F.col("w") - F.coalesce("stay", F.lit(0.0))) / all_ - F.col("k") * (F.col("to_sum") + F.col("k") - F.col("own_sum")) / all_**2)
    best = away.withColumn("gain", gain).where(F.col("gain") > GAIN).groupBy("i", "k", "own").agg(F.min_by(F.struct("to", "gain"), F.struct(-F.col("gain"), F.col("to"))).alias("x"))
    wish = write_table(best.select("i", "k", "own", "x.to", "x.gain"), "wishes")
    if wish.isEmpty():
        return wish, False
    key = F.struct("gain", (-F.col("i")).alias("i"), (-F.col("to")).alias("to")) if dict(wish.dtypes)["i"] in ("bigint", "int") else F.struct("gain", "i", "to")
    keyed = wish.withColumn("key", key)
    most = keyed.select(F.explode(F.array("own", "to")).alias("c"), "key", "to").groupBy("c").agg(F.max_by("to", "key").alias("to"))
    takers = most.where(F.col("to") == F.col("c")).select("to")
    rank = F.struct((-F.floor(F.log2("gain") * STEPS)).alias("step"), F.pmod(F.xxhash64(F.lit(turn), "i"), F.lit(SPREAD)).alias("at"))
    gives = keyed.join(takers, "to", "left_semi").join(takers.withColumnRenamed("to", "own"), "own", "left_anti").withColumn("rank", rank)
    cells = gives.select(F.explode(F.array("own", "to")).alias("c"), "rank", "k", "key").groupBy("c", "rank").agg(F.sum("k").alias("all_k"), F.max("key").alias("top"))
    better = F.sum("all_k").over(Window.partitionBy("c").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("better", F.coalesce(better, F.lit(0.0)))
    for side in ("own", "to"):
        of = cells.select(F.col("c").alias(side), "rank", "all_k", "top", "better")
        gives = gives.join(of, [side, "rank"]).withColumn(f"{side}_before", F.col("better") + F.when(F.col("key") == F.col("top"), 0.0).otherwise(F.col("all_k") - F.col("k"))).drop("all_k", "top", "better")
    safe = F.col("gain") - 2 * F.col("k") * (F.col("own_before") + F.col("to_before")) / all_**2 > GAIN
    return gives.where(safe).select("i", F.col("to").alias("moved")), True


def _turn(i: np.ndarray, j: np.ndarray, w: np.ndarray, k: np.ndarray, c: np.ndarray, all_: float, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """``_moves`` over arrays: (the nodes that move, where to, whether any node gains by a move at all); nodes and communities are numbers."""
    n = len(k)
    toward = i * n + c[j]
    order = np.argsort(toward, kind="stable")
    toward = toward[order]
    first = np.flatnonzero(np.diff(toward, prepend=-1))
    if not len(first):
        return first, first, False
    at, to, weight = toward[first] // n, toward[first] % n, np.add.reduceat(w[order], first)
    sums, stay = np.bincount(c, k, n), np.zeros(n)
    home = to == c[at]
    stay[at[home]] = weight[home]
    gain = 2 * ((weight - stay[at]) / all_ - k[at] * (sums[to] + k[at] - sums[c[at]]) / all_**2)
    far = ~home & (gain > GAIN)
    at, to, gain = at[far], to[far], gain[far]
    if not len(at):
        return at, to, False
    of = np.flatnonzero(np.diff(at, prepend=-1))  # rows of a node go by ``to``: the first of the largest gains is its wish
    best = np.flatnonzero(gain == np.repeat(np.maximum.reduceat(gain, of), np.diff(of, append=len(at))))
    best = best[np.diff(at[best], prepend=-1) != 0]
    at, to, gain = at[best], to[best], gain[best]
    own, mine = c[at], k[at]
    key = np.empty(len(at), np.int64)
    key[np.lexsort((-at, gain))] = np.arange(len(at))
    most = np.full(n, -1)
    np.maximum.at(most, own, key)
    np.maximum.at(most, to, key)
    by_key = np.empty(len(at), np.int64)
    by_key[key] = to
    takes = (most >= 0) & (by_key[most] == np.arange(n))
    gives = takes[to] & ~takes[own]
    at, to, gain, own, mine, key = (x[gives] for x in (at, to, gain, own, mine, key))
    rank = -np.floor(np.log2(gain) * STEPS).astype(np.int64) * SPREAD + (salt[at] % np.uint64(SPREAD)).astype(np.int64)
    places, ranks, twice = np.concatenate([own, to]), np.concatenate([rank, rank]), np.concatenate([mine, mine])
    order = np.lexsort((ranks, places))
    new = np.diff(places[order], prepend=-1) != 0
    cell_new = new | (np.diff(ranks[order], prepend=0) != 0)
    cells = np.flatnonzero(cell_new)
    all_k, top = np.add.reduceat(twice[order], cells), np.maximum.reduceat(np.concatenate([key, key])[order], cells)
    better = np.cumsum(all_k) - all_k
    community = np.flatnonzero(new[cells])
    better -= np.repeat(better[community], np.diff(community, append=len(cells)))
    cell = np.empty(len(places), np.int64)
    cell[order] = np.cumsum(cell_new) - 1
    before = better[cell] + np.where(np.concatenate([key, key]) == top[cell], 0.0, all_k[cell] - twice)
    safe = gain - 2 * mine * (before[: len(at)] + before[len(at) :]) / all_**2 > GAIN
    return at[safe], to[safe], True


def _settle(i: np.ndarray, j: np.ndarray, w: np.ndarray, salt: np.ndarray, all_: float, trace: list[np.ndarray] | None = None) -> np.ndarray:
    """The community of each node, the number of its smallest node, from links (i, j, w) of whole components in both directions, sorted.

    Nodes are numbers from 0 in the order of their names; ``salt`` is a hash of each name.  Components don't change one another's communities.
    ``trace`` is given the communities after each turn.
    """
    groups, names = np.arange(len(salt)), np.arange(len(salt))
    while True:
        n = len(salt)
        k, c, moved, turn = np.bincount(i, w, n), np.arange(n), False, 0
        away = i != j
        from_, to_, weight = i[away], j[away], w[away]
        while True:
            mixed = (salt + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            at, to, left = _turn(from_, to_, weight, k, c, all_, mixed >> np.uint64(32))
            turn += 1
            if not left:
                break
            moved = True
            c[at] = to
            if trace is not None:
                trace.append(names[c][groups])
        if not moved:
            break
        kept = np.unique(c)
        at = np.searchsorted(kept, c)
        groups, names, salt = at[groups], names[kept], salt[kept]
        both = at[i] * len(kept) + at[j]
        order = np.argsort(both, kind="stable")
        first = np.flatnonzero(np.diff(both[order], prepend=-1))
        i, j, w = both[order][first] // len(kept), both[order][first] % len(kept), np.add.reduceat(w[order], first)
    smallest = np.full(len(salt), len(groups))
    np.minimum.at(smallest, groups, np.arange(len(groups)))
    return smallest[groups]


def _settled(links: DataFrame, all_: float, parts: int = 1, whole: int = WHOLE) -> DataFrame:
    """(node, community) by ``_settle``: with one part of all links, else of whole components (``component``) until a task has ``whole`` links at a time."""
    one = parts == 1
    rows = links.select(*[F.lit(0).alias("component")] if one else ["component"], "i", "j", "w", F.xxhash64("i").alias("salt"))
    rows = rows.repartition(parts, "component").sortWithinPartitions("component", "i", "j")

    def settle(frames: list[pd.DataFrame]) -> pd.DataFrame:
        frame = pd.concat(frames)
        names, first = np.unique(frame["i"].to_numpy(), return_index=True)
        i, j = np.searchsorted(names, frame["i"].to_numpy()), np.searchsorted(names, frame["j"].to_numpy())
        order = np.lexsort((j, i))
        salt = frame["salt"].to_numpy()[first].view(np.uint64)
        return pd.DataFrame({"node": names, "community": names[_settle(i[order], j[order], frame["w"].to_numpy()[order], salt, all_)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            if batch.empty:
                continue
            if size and (size >= whole or size + len(batch) > whole) and not one:
                # What is held ends with its last component, whose rest may be in this batch.
                name = held[-1]["component"].iloc[-1]
                same = int((batch["component"].to_numpy() == name).sum())
                if same < len(batch):
                    yield settle([*held, batch.iloc[:same]])
                    held, size, batch = [], 0, batch.iloc[same:]
            held.append(batch)
            size += len(batch)
        if held:
            yield settle(held)

    kind = dict(links.dtypes)["i"]
    return rows.mapInPandas(run, f"node {kind}, community {kind}")


def communities(edges: DataFrame, a: str = "a", b: str = "b", weight: str | None = None, trace: list[float] | None = None, whole: int = WHOLE) -> DataFrame:
    """(node, community): groups of high modularity; a community's name is its smallest node.

    Nodes move to the neighbouring community that gains most, until none gains; then communities become the nodes of
    a smaller graph, and so on until no move is left.  Moves are made many at a time but so that their gains add up: a community
    takes in a turn if the best move that touches it is one into it; only communities that don't take give, any number of
    nodes.  A node moves if it still gains where all better ones leave its community and enter the other with it: nodes that
    leave or enter together cost one another only by their degrees, links between them help.
    So modularity rises with every turn, and the search ends.
    Ties go to smaller names.

    Communities never cross components, so a graph of up to ``whole`` links (both directions), and of a larger one the
    components of up to as many, are searched by tasks that hold some whole components each.  Components beyond that are searched by joins: the graph, its
    communities and the moves are tables all the while, no task holds a node's edges or a community's members, and degrees of better moves
    are summed by steps of the gain, in each by hash; once such a search has made the graph small enough, a task ends it.  Nothing
    but flags, counts and the total weight reaches the driver.  Tables of earlier turns are dropped.
    Whole weights make the result independent of partitions.  ``trace`` is given the modularity (of what is searched by joins) after each turn
    of joins, and that of the whole at the end.
    """
    ship(edges.sparkSession)
    links = write_table(links_of(edges, a, b, weight), "links")
    rows, all_ = links.agg(F.count("*"), F.sum("w")).first()
    if not rows:
        return links.select(F.col("i").alias("node"), F.col("j").alias("community"))
    if rows <= whole:
        found = _settled(links, all_)
    else:
        of = components(links, "i", "j").withColumnRenamed("node", "i")
        parted = write_table(links.join(of, "i"), "links")
        large = write_table(parted.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > whole).select("component"), "large")
        parts = min(rows, max(2, -(-4 * rows // max(whole, 1))))
        if large.isEmpty():
            found = _settled(parted, all_, parts, whole)
        else:
            found = _joined(write_table(parted.join(large, "component", "left_semi").select("i", "j", "w"), "links"), all_, trace, whole)
            small = parted.join(large, "component", "left_anti")
            if not small.isEmpty():
                found = found.unionByName(_settled(small, all_, parts, whole))
    if trace is not None:
        found = write_table(found, "groups")
        trace.append(modularity(links, found))
    return found


def _joined(links: DataFrame, all_: float, trace: list[float] | None, whole: int) -> DataFrame:
    """(node, community) of graphs of any size, by joins."""
    first = links
    groups = write_table(first.select(F.col("i").alias("node")).distinct().withColumn("community", F.col("node")), "groups")
    turn = 0
    while True:
        if 0 < links.count() <= whole:
            last = _settled(links, all_).withColumnRenamed("community", "c").withColumnRenamed("node", "community")
            groups = write_table(groups.join(last, "community").select("node", F.col("c").alias("community")), "groups")
            break
        state = write_table(links.groupBy("i").agg(F.sum("w").alias("k")).withColumn("c", F.col("i")), "state")
        moved = False
        while True:
            moves, any_left = _moves(links, state, all_, turn)
            turn += 1
            if not any_left:
                break
            moved = True
            state = write_table(state.join(moves, "i", "left").select("i", "k", F.coalesce("moved", "c").alias("c")), "state")
            drop_tables(state.sparkSession, written(state.sparkSession)[-3:-1])  # the turn's wishes and the state before
            if trace is not None:
                now = groups.join(state.select(F.col("i").alias("community"), "c"), "community").select("node", F.col("c").alias("community"))
                trace.append(modularity(first, now))
        if not moved:
            break
        names = state.select("i", "c")
        groups = write_table(groups.join(names.withColumnRenamed("i", "community"), "community").select("node", F.col("c").alias("community")), "groups")
        to = names.select(F.col("i").alias("j"), F.col("c").alias("cj"))
        links = write_table(links.join(names, "i").join(to, "j").groupBy(F.col("c").alias("i"), F.col("cj").alias("j")).agg(F.sum("w").alias("w")), "links")
    names = groups.groupBy("community").agg(F.min("node").alias("name"))
    return groups.join(names, "community").select("node", F.col("name").alias("community"))
