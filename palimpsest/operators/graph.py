"""Graph operators over node and edge frames.

Walks and activation are bounded unrolled joins that keep the best value a (seed, node) each
round, which is exact for products of factors of at most 1.  Iterative measures write each round
to the shared folder.  Hubs are pre-aggregated before every shuffle.

Unusual cases: edges to missing nodes are dropped where nodes are given; self loops are ignored;
parallel edges count by their greatest weight; no seeds give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.sequence import day_bucket, following, preceding
from palimpsest.runtime import Scratch


def symmetric(edges: DataFrame, minimum: float = 0.0) -> DataFrame:
    """(src, dst, weight) both ways, the greatest weight of parallel edges, no loops."""
    e = edges.where((F.col("weight") >= minimum) & (F.col("src") != F.col("dst")))
    return e.select("src", "dst", "weight").union(e.select(F.col("dst"), F.col("src"), "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def walk(edges: DataFrame, seeds: DataFrame, hops: int = 2, minimum: float = 0.2, limit: int | None = 20, edge_types: list[str] | None = None) -> DataFrame:
    """Association walk: (id, depth, strength) reached from ``seeds(id)`` over edges of strength
    ``minimum`` at least, in both directions, by the strongest path of at most ``hops`` edges."""
    if edge_types is not None:
        edges = edges.where(F.col("edge_type").isin(edge_types))
    both = symmetric(edges, minimum)
    reached = spread(both, seeds.select(F.col("id").alias("node"), F.lit(1.0).alias("value")).distinct(), hops, decay=1.0, threshold=0.0)
    out = reached.join(seeds.select(F.col("id").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("id"), "depth", F.col("value").alias("strength"))
    return out if limit is None else out.orderBy(F.round("strength", 6).desc(), "id").limit(limit)


def spread(both: DataFrame, seeds: DataFrame, hops: int, decay: float, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Max-product spreading: (by.., node, value, depth).  ``seeds(by.., node, value)``.

    A frontier value that falls under the threshold can never rise again, so it is cut early.
    """
    by = by or []
    best = seeds.select(*by, "node", "value", F.lit(0).alias("depth"))
    frontier = best
    every = best
    for depth in range(1, hops + 1):
        step = frontier.join(both, F.col("node") == F.col("src")).select(*by, F.col("dst").alias("node"), (F.col("value") * F.col("weight") * decay).alias("value"))
        step = step.where(F.col("value") >= threshold) if threshold > 0 else step
        frontier = step.groupBy(*by, "node").agg(F.max("value").alias("value")).withColumn("depth", F.lit(depth))
        every = every.unionByName(frontier)
    return every.groupBy(*by, "node").agg(F.max("value").alias("value"), F.min("depth").alias("depth"))


def activate(edges: DataFrame, seeds: DataFrame, hidden: DataFrame | None = None, hops: int = 2, decay: float = 0.6, threshold: float = 0.05, budget: int = 100, minimum: float = 0.01) -> DataFrame:
    """Spreading activation: (node, activation, depth), nodes of ``hidden(node)`` neither passed
    nor reached, at most ``budget`` nodes."""
    if hidden is not None:
        for end in ("src", "dst"):
            edges = edges.join(hidden.select(F.col("node").alias(end)), end, "left_anti")
        seeds = seeds.join(hidden, "node", "left_anti")
    reached = spread(symmetric(edges, minimum), seeds.groupBy("node").agg(F.max("value").alias("value")), hops, decay, threshold)
    reached = reached.where((F.col("depth") > 0) & (F.col("value") >= threshold)).join(seeds.select("node").distinct(), "node", "left_anti")
    return reached.orderBy(F.round("value", 6).desc(), "node").limit(budget).select("node", F.col("value").alias("activation"), "depth")


def converge(groups: DataFrame) -> DataFrame:
    """``groups(attribute, node, value)`` -> (node, activation): the greatest value, times 1.2 for
    every further attribute that reached the node, at most 1."""
    g = groups.groupBy("node").agg(F.count_distinct("attribute").alias("n"), F.max("value").alias("value"))
    return g.select("node", "n", F.least(F.lit(1.0), F.col("value") * F.pow(F.lit(1.2), F.col("n") - 1)).alias("activation"))


def split_activation(activated: DataFrame, bridges: DataFrame, primary: float = 0.1, faint: float = 0.03) -> DataFrame:
    """Halves bridge nodes, then marks primary and faint associations."""
    a = activated.join(bridges.select("node").distinct().withColumn("_b", F.lit(True)), "node", "left")
    value = F.when(F.col("_b"), F.col("activation") * 0.5).otherwise(F.col("activation"))
    a = a.withColumn("activation", value).drop("_b")
    return a.withColumn("level", F.when(F.col("activation") >= primary, "primary").when(F.col("activation") >= faint, "faint")).where("level is not null")


def neighbours(edges: DataFrame, node: str, edge_type: str | None = None, direction: str = "both", limit: int = 50) -> DataFrame:
    e = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    out = e.where(F.col("src") == node).select(F.col("dst").alias("node"), "weight")
    into = e.where(F.col("dst") == node).select(F.col("src").alias("node"), "weight")
    rows = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
    return rows.groupBy("node").agg(F.max("weight").alias("weight")).orderBy(F.col("weight").desc(), "node").limit(limit)


def merge_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Edge upsert: the greatest weight, traversals added up."""
    every = stored.select("src", "dst", "edge_type", "weight", "traversals").unionByName(new.select("src", "dst", "edge_type", "weight", F.lit(1).cast("long").alias("traversals")))
    return every.groupBy("src", "dst", "edge_type").agg(F.max("weight").alias("weight"), F.sum("traversals").alias("traversals"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-7, cut: int = 5) -> DataFrame:
    """(node, rank) by power iteration on the symmetric weighted graph; dangling mass does not
    arise since every edge goes both ways.  The lineage is cut, and the tolerance looked at, every
    ``cut`` rounds."""
    scratch = Scratch(edges.sparkSession, "pagerank")
    both = symmetric(edges).where("weight > 0")
    out = both.groupBy("src").agg(F.sum("weight").alias("total"))
    moves = scratch.keep(both.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")), "moves")
    # partitioned by source once, so that a round shuffles ranks and gains alone; blocks that are
    # lost with an executor are read again from the table
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moves = moves.repartition(parts, "src").persist(StorageLevel.MEMORY_AND_DISK)
    rank = held = scratch.keep(moves.select(F.col("src").alias("node")).distinct().withColumn("rank", F.lit(1.0)), "rank")
    done = 0
    while done < rounds:
        step = min(cut, rounds - done)
        for _ in range(step):
            gain = moves.join(rank, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("gain"))
            rank = rank.join(gain, F.col("node") == F.col("dst"), "left").select("node", F.col("rank").alias("was"), ((1 - damping) + damping * F.coalesce("gain", F.lit(0.0))).alias("rank"))
        done += step
        new = scratch.keep(rank, "rank")
        moved = new.agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
        scratch.drop(held)
        held, rank = new, new.select("node", "rank")
        if moved < tolerance:
            break
    moves.unpersist()
    return rank


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) by weighted label propagation: every round a node takes the label of the
    greatest summed weight among its neighbours (its own counts its mean edge weight), ties to the
    smallest label; even and odd nodes move in turn so that labels settle."""
    scratch = Scratch(edges.sparkSession, "communities")
    both = scratch.keep(symmetric(edges), "edges")
    own = both.groupBy("src").agg(F.avg("weight").alias("weight"))
    labels = held = scratch.keep(both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")), "labels")
    for _ in range(rounds):
        start = labels
        for half in (0, 1):
            votes = both.join(labels, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node"), "community").agg(F.sum("weight").alias("w"))
            self_vote = labels.join(own, F.col("node") == F.col("src")).select("node", "community", F.col("weight").alias("w"))
            total = votes.unionByName(self_vote).groupBy("node", "community").agg(F.round(F.sum("w"), 9).alias("w"))
            won = total.groupBy("node").agg(F.min(F.struct(-F.col("w"), "community")).alias("best"))
            turn = F.pmod(F.xxhash64("node"), F.lit(2)) == half
            labels = labels.join(won, "node").select("node", F.when(turn, F.col("best.community")).otherwise(F.col("community")).alias("community"))
        was = start.select("node", F.col("community").alias("was"))
        new = scratch.keep(labels.join(was, "node").select("node", "was", "community"), "round")
        still = new.where("was <> community").isEmpty()
        scratch.drop(held)
        held, labels = new, new.select("node", "community")
        if still:
            break
    return labels


def louvain(edges: DataFrame, levels: int = 10, rounds: int = 10, seed: int = 0, sent_edges: int | None = None) -> DataFrame:
    """(node, community) by modularity: in every round a node moves to the neighbouring community of
    the greatest gain, half of the nodes (by hash) at a time; when no round gains any more the
    communities become nodes and the next level begins.  A level ends early, and a round that
    lowers the modularity is not taken.  A community is named by its least node.

    Ties go to the least community.  No edges give an empty result.  A graph of at most
    ``sent_edges`` (by default ``SENT_EDGES``) is worked off in one task by the same steps; a larger
    one stays in tables.
    """
    scratch = Scratch(edges.sparkSession, "louvain")
    graph = scratch.keep(symmetric(edges).where("weight > 0"), "graph")
    if graph.count() <= (SENT_EDGES if sent_edges is None else sent_edges):
        return scratch.keep(_task_louvain(graph, levels, rounds, seed), "names")
    total = graph.agg(F.sum("weight")).first()[0]  # twice the weight of all edges
    names = scratch.keep(graph.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")), "names")
    if total is None:
        return names
    best = -1.0
    for _ in range(levels):
        degree = scratch.keep(graph.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")), "degree")
        labels = scratch.keep(degree.select("node", F.col("node").alias("community"), "k"), "labels")
        gained = False
        for step in range(2 * rounds):
            moved = scratch.keep(_moved(graph, labels, total, F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(2)) == step % 2), "moved")
            value = _modularity(graph, moved, total)
            if value > best + 1e-9:
                best, labels, gained = value, moved, True
            elif step % 2:
                break
        if not gained:
            break
        # named by the least member, for all nodes of the level
        least = labels.groupBy("community").agg(F.min("node").alias("name"))
        level = scratch.keep(labels.join(least, "community").select("node", "name"), "level")
        names = scratch.keep(names.join(level, names["community"] == level["node"]).select(names["node"], F.col("name").alias("community")), "names")
        ends = [level.select(F.col("node").alias(end), F.col("name").alias(f"_{end}")) for end in ("src", "dst")]
        graph = scratch.keep(graph.join(ends[0], "src").join(ends[1], "dst").groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.sum("weight").alias("weight")), "graph")
    least = names.groupBy("community").agg(F.min("node").alias("name"))
    return names.join(least, "community").select("node", F.col("name").alias("community"))


def _task_louvain(graph: DataFrame, levels: int, rounds: int, seed: int) -> DataFrame:
    """The steps of ``louvain`` over arrays; names are numbered in their order."""
    turn = F.pmod(F.xxhash64("src", F.lit(seed)), F.lit(2)).cast("byte").alias("turn")
    kind = graph.schema["src"].dataType.simpleString()

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        links = pa.Table.from_batches(batches)
        node = pc.unique(links.column("src"))
        node = node.take(pc.array_sort_indices(node))
        src, dst = (_places(links.column(end), node) for end in ("src", "dst"))
        turn = np.zeros(len(node), dtype=np.int8)
        turn[src] = links.column("turn").to_numpy()
        names = _louvain_names(src, dst, links.column("weight").to_numpy(), turn, levels, rounds)
        yield from pa.table({"node": node, "community": node.take(pa.array(names))}).to_batches(max_chunksize=10_000)

    return graph.select("src", "dst", "weight", turn).coalesce(1).mapInArrow(run, f"node {kind}, community {kind}")


def _louvain_names(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, turn: np.ndarray, levels: int, rounds: int) -> np.ndarray:
    """The number of the least member of each node's community."""
    total = weight.sum()
    names = np.arange(len(turn))
    own = names  # of the nodes of the level: the least node in them
    best = -1.0
    for _ in range(levels):
        n = len(own)
        degree = np.bincount(src, weights=weight, minlength=n)
        labels, gained = np.arange(n), False
        loops = src == dst
        from_, to, between = src[~loops], dst[~loops], weight[~loops]
        for step in range(2 * rounds):
            mass = np.bincount(labels, weights=degree, minlength=n)
            # staying is a choice too
            key, at = np.unique(np.r_[from_.astype(np.int64) * n + labels[to], np.arange(n) * n + labels], return_inverse=True)
            w = np.bincount(at, weights=np.r_[between, np.zeros(n)])
            who, community = key // n, key % n
            others = mass[community] - np.where(community == labels[who], degree[who], 0.0)
            gain = np.round(w - degree[who] * others / total, 9)
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            most = np.maximum.reduceat(gain, first)
            won = np.flatnonzero(gain == most[who])
            won = won[np.r_[True, who[won][1:] != who[won][:-1]]]  # the least of equal ones
            moved = np.where(turn[own] == step % 2, community[won], labels)
            mass = np.bincount(moved, weights=degree, minlength=n)
            value = weight[moved[src] == moved[dst]].sum() / total - ((mass / total) ** 2).sum()
            if value > best + 1e-9:
                best, labels, gained = value, moved, True
            elif step % 2:
                break
        if not gained:
            break
        # named by the least member
        least = np.full(n, n)
        np.minimum.at(least, labels, np.arange(n))
        kept, level = np.unique(least[labels], return_inverse=True)
        names = level[names]
        key, at = np.unique(level[src].astype(np.int64) * len(kept) + level[dst], return_inverse=True)
        src, dst, weight = key // len(kept), key % len(kept), np.bincount(at, weights=weight)
        own = own[kept]
    return own[names]


def _moved(graph: DataFrame, labels: DataFrame, total: float, turn: Column) -> DataFrame:
    """Labels after the nodes of ``turn`` have gone where the modularity gains most."""
    mass = labels.groupBy("community").agg(F.sum("k").alias("mass"))
    around = graph.where("src <> dst").join(labels.select(F.col("node").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("weight").alias("w"))
    own = labels.select("node", "community", F.lit(0.0).alias("w"))  # staying is a choice too
    choice = around.unionByName(own).groupBy("node", "community").agg(F.sum("w").alias("w")).join(mass, "community")
    choice = choice.join(labels.select("node", F.col("community").alias("was"), "k"), "node")
    others = F.col("mass") - F.when(F.col("community") == F.col("was"), F.col("k")).otherwise(0.0)
    gain = F.round(F.col("w") - F.col("k") * others / total, 9)
    won = choice.groupBy("node", "was", "k").agg(F.min(F.struct(-gain, "community")).alias("best"))
    return won.select("node", F.when(turn, F.col("best.community")).otherwise(F.col("was")).alias("community"), "k")


def _modularity(graph: DataFrame, labels: DataFrame, total: float) -> float:
    at = [labels.select(F.col("node").alias(end), F.col("community").alias(f"_{end}")) for end in ("src", "dst")]
    inside = graph.join(at[0], "src").join(at[1], "dst").where("_src = _dst").agg(F.sum("weight")).first()[0] or 0.0
    apart = labels.groupBy("community").agg(F.sum("k").alias("mass")).agg(F.sum(F.pow(F.col("mass") / total, 2))).first()[0] or 0.0
    return inside / total - apart


#: distinct edges that may be sent to the tasks (16 bytes each)
SENT_EDGES = 2_000_000


def betweenness(edges: DataFrame, sources: DataFrame | None = None, sent_edges: int = SENT_EDGES, batch: int = 512) -> DataFrame:
    """(node, score): unnormalised betweenness over unweighted shortest paths of any length, from all
    nodes or the given ``sources(node)``.

    Behind a check of its size the graph is cut at its articulation points: pairs in different
    branches at a node are counted by the sizes of the branches, and the tasks search the blocks of
    three nodes and more alone, from nodes with three neighbours and more.  A larger graph stays in tables, and batches of sources are joined
    with it.
    """
    scratch = Scratch(edges.sparkSession, "betweenness")
    both = scratch.keep(symmetric(edges).select("src", "dst"), "edges")
    nodes = scratch.keep(both.select(F.col("src").alias("node")).distinct(), "nodes")
    asked = nodes if sources is None else scratch.keep(sources.select("node").distinct().join(nodes, "node"), "sources")
    # written, so that who reads the scores twice does not search twice
    if both.count() <= sent_edges:
        return scratch.keep(_sent_betweenness(both, nodes, asked), "scores")
    parts = max(1, -(-asked.count() // batch))
    scores = None
    for part in range(parts):
        some = _joined_betweenness(both, asked.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == part), scratch)
        scores = some if scores is None else scores.unionByName(some)
    whole = nodes.join(scores.groupBy("node").agg(F.sum("score").alias("score")), "node", "left")
    return scratch.keep(whole.select("node", F.coalesce("score", F.lit(0.0)).alias("score")), "scores")


def _blocks(start: np.ndarray, dst: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, list[tuple[int, list[int], list[tuple[int, int]]]], np.ndarray, np.ndarray]:
    """Biconnected blocks of a symmetric graph without loops, depth first without recursion.

    -> (score of the pairs that a node separates, blocks of three nodes and more as (head, other
    nodes, edges), nodes hanging at each node away from its root, those of them that are asked).
    The head's own weight in a block is the rest of its component.
    """
    n = len(start) - 1
    first, near = start.tolist(), dst.tolist()
    number, low, at, up = [-1] * n, [0] * n, first[:-1], [-1] * n
    hang, hang_s = [1] * n, asked.astype(int).tolist()
    pairs = [0] * n  # (asked, any) pairs that lie in one branch at a node
    root = [0] * n
    blocks = []
    count = 0
    for origin in range(n):
        if number[origin] >= 0:
            continue
        number[origin] = low[origin] = count
        count += 1
        root[origin] = origin
        path, links = [origin], []
        while path:
            x = path[-1]
            if at[x] < first[x + 1]:
                y = near[at[x]]
                at[x] += 1
                if number[y] < 0:
                    links.append((x, y))
                    number[y] = low[y] = count
                    count += 1
                    up[y], root[y] = x, origin
                    path.append(y)
                elif y != up[x] and number[y] < number[x]:
                    links.append((x, y))
                    low[x] = min(low[x], number[y])
                continue
            path.pop()
            if not path:
                continue
            u = path[-1]
            low[u] = min(low[u], low[x])
            if low[x] >= number[u]:
                own = []
                while True:
                    own.append(links.pop())
                    if own[-1] == (u, x):
                        break
                if len(own) == 1:
                    others = [x]
                else:
                    others = list({e for link in own for e in link} - {u})
                    blocks.append((u, others, own))
                below, below_s = sum(hang[v] for v in others), sum(hang_s[v] for v in others)
                pairs[u] += below * below_s
                hang[u] += below
                hang_s[u] += below_s
    hang, hang_s, root = (np.array(v, dtype=np.int64) for v in (hang, hang_s, root))
    rest, rest_s = (hang[root] - hang).astype(float), (hang_s[root] - hang_s).astype(float)
    score = (hang_s[root] - asked) * (hang[root] - 1.0) - np.array(pairs, dtype=float) - rest * rest_s
    return score, blocks, np.stack([hang, hang[root]]), np.stack([hang_s, hang_s[root]])


def _places(values: pa.ChunkedArray, known: pa.Array) -> np.ndarray:
    return pc.index_in(values, value_set=known).to_numpy().astype(np.int32)


def _sent_betweenness(both: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs in different branches are counted here; the dependencies of each group of sources within
    their block are summed up in the task that works it off."""
    spark = both.sparkSession
    kind = both.schema["src"].dataType.simpleString()
    schema = f"node {kind}, score double"
    node = nodes.toArrow().column("node").combine_chunks()
    if not len(node):
        return spark.createDataFrame([], schema)
    links = both.toArrow()  # at most ``sent_edges``
    src, dst = (_places(links.column(end), node) for end in ("src", "dst"))
    order = np.argsort(src, kind="stable")
    start = np.searchsorted(src[order], np.arange(len(node) + 1))
    wanted = np.zeros(len(node), dtype=np.int64)
    wanted[_places(asked.toArrow().column("node"), node)] = 1
    score, blocks, hang, hang_s = _blocks(start, dst[order], wanted)
    apart = spark.createDataFrame(pa.table({"node": node, "score": score}), schema)
    if not blocks:
        return apart

    # all blocks side by side: a node that lies in several has a place in each
    name, weight, weight_s, ends, bounds = [], [], [], [], [0]
    for head, others, own in blocks:
        place = {v: len(name) + i for i, v in enumerate((head, *others))}
        name += place
        others = np.array(others)
        weight.append(np.r_[hang[1, head] - hang[0, others].sum(), hang[0, others]])
        weight_s.append(np.r_[hang_s[1, head] - hang_s[0, others].sum(), hang_s[0, others]])
        ends += [(place[a], place[b]) for a, b in own]
        bounds.append(len(name))
    name, ends, bounds = np.array(name), np.array(ends, dtype=np.int32), np.array(bounds)
    weight, weight_s = np.concatenate(weight).astype(float), np.concatenate(weight_s).astype(float)
    src, dst = np.r_[ends[:, 0], ends[:, 1]], np.r_[ends[:, 1], ends[:, 0]]
    order = np.argsort(src, kind="stable")
    start, dst = np.searchsorted(src[order], np.arange(len(name) + 1)), dst[order]
    groups = _groups(start, dst, weight_s, bounds)
    sent = spark.sparkContext.broadcast((node.take(pa.array(name)), start, dst, weight, weight_s, bounds, groups))

    def run(batches):
        node, start, dst, weight, weight_s, bounds, groups = sent.value
        own = [groups[g] for b in batches for g in b.column("id").to_pylist()]
        score = _dependencies(start, dst, weight, weight_s, bounds, own)
        some = np.flatnonzero(score)
        yield pa.RecordBatch.from_arrays([node.take(pa.array(some)), pa.array(score[some])], names=["node", "score"])

    tasks = 4 * spark.sparkContext.defaultParallelism
    sources = spark.createDataFrame(pa.table({"id": np.arange(len(groups))})).repartition(tasks, "id")
    within = sources.mapInArrow(run, schema)
    return apart.unionByName(within).groupBy("node").agg(F.sum("score").alias("score"))


def _groups(start: np.ndarray, dst: np.ndarray, weight_s: np.ndarray, bounds: np.ndarray, most: int = 8) -> list[tuple[list[int], list[bool], list[tuple[int, int, list[int]]]]]:
    """What is searched together: (nodes, whether each is a source itself here, chains between them
    as (end, other end, nodes within)).

    A chain is a path of nodes that have two neighbours each.  They are no sources of a search:
    what they reach follows from the searches of the two ends.  So groups grow along chains, and an
    end outside of the group is searched once more.  Of a ring two nodes are taken as ends.
    """
    first, near, asked = start.tolist(), dst.tolist(), (weight_s > 0).tolist()
    core = np.diff(start) != 2
    rings = np.flatnonzero(np.add.reduceat(core.astype(int), bounds[:-1]) == 0)
    core[bounds[rings]] = core[dst[start[bounds[rings]]]] = True
    core = core.tolist()
    chains, along = [], {}
    for u in range(len(core)):
        for y in near[first[u] : first[u + 1]] if core[u] else ():
            before, inner = u, []
            while not core[y]:
                inner.append(y)
                a, b = near[first[y] : first[y + 1]]
                before, y = y, b if a == before else a
            if u < y and any(asked[z] for z in inner):
                along.setdefault(u, []).append((y, len(chains)))
                along.setdefault(y, []).append((u, len(chains)))
                chains.append((u, y, inner))
    groups, home = [], {}
    for u in sorted((u for u in range(len(core)) if core[u] and (asked[u] or u in along)), key=lambda u: len(along.get(u, ()))):
        if u in home:
            continue
        nodes, path = {}, [u]
        while path and len(nodes) < most:
            x = path.pop()
            if x not in home:
                home[x] = len(groups)
                nodes[x] = len(nodes)
                path += [y for y, _ in along.get(x, ()) if y not in home]
        groups.append((nodes, []))
    own = [len(nodes) for nodes, _ in groups]
    for u, v, inner in chains:
        # where both ends are, else where there is room for the other one
        at = next((g for g in (home[u], home[v]) if u in groups[g][0] and v in groups[g][0]), None)
        if at is None:
            at = next((g for g in (home[u], home[v]) if len(groups[g][0]) < 2 * most), len(groups))
        if at == len(groups):
            groups.append(({}, []))
            own.append(0)
        nodes = groups[at][0]
        for end in (u, v):
            nodes.setdefault(end, len(nodes))
        groups[at][1].append((nodes[u], nodes[v], inner))
    return [(list(nodes), [k < n for k in range(len(nodes))], inside) for (nodes, inside), n in zip(groups, own)]


def _dependencies(start: np.ndarray, dst: np.ndarray, weight: np.ndarray, weight_s: np.ndarray, bounds: np.ndarray, groups: list, at_once: int = 1 << 19) -> np.ndarray:
    """Sum over the sources of their dependency on each node; targets count by ``weight``, sources
    by ``weight_s``.  Several nodes are searched at once, level by level, each in its block; on the
    way back a target counts for the node and for the chains that reach it through the node."""
    n = len(start) - 1
    score, size = np.zeros(n), np.diff(start)
    a = 0
    while a < len(groups):
        rows, own, chains, room = [], [], [], 0
        while a < len(groups):
            nodes, mine, inside = groups[a]
            at = np.searchsorted(bounds, nodes, "right")
            more = int((bounds[at] - bounds[at - 1]).sum())
            if rows and room + more > at_once:
                break
            chains += [(p + len(rows), q + len(rows), inner) for p, q, inner in inside]
            rows += nodes
            own += mine
            room += more
            a += 1
        front = np.array(rows, dtype=np.int64)
        at = np.searchsorted(bounds, front, "right")
        lo, many = bounds[at - 1], bounds[at] - bounds[at - 1]
        begin = np.cumsum(many) - many  # each search has places for the nodes of its block
        base = begin - lo
        counts = weight_s[front] * np.array(own)
        paths = np.ones(len(front))
        reached, place = np.zeros(room, dtype=bool), np.empty(room, dtype=np.int32)
        depth, every = np.zeros(room, dtype=np.int64), np.ones(room)
        wanted = np.repeat(counts, many) * weight[np.arange(room) - np.repeat(base, many)]
        reached[base + front] = True
        levels, links = [(front, base, paths)], []
        while True:
            out = size[front]
            owner = np.repeat(np.arange(len(front)), out)
            to = dst[np.arange(len(owner)) + np.repeat(start[front] - (np.cumsum(out) - out), out)] + base[owner]
            fresh = np.flatnonzero(~reached[to])
            if not len(fresh):
                break
            owner, to = owner[fresh], to[fresh]
            # once each, without sorting: the last that wrote its number stands for all
            turn = np.arange(len(to), dtype=np.int32)
            place[to] = turn
            last = place[to] == turn
            new, base = to[last], base[owner[last]]
            place[new] = np.arange(len(new), dtype=np.int32)
            child = place[to]
            reached[new] = True
            paths = np.bincount(child, weights=paths[owner], minlength=len(new))
            front = new - base
            depth[new], every[new] = len(levels), paths
            levels.append((front, base, paths))
            links.append((owner, child))
        for p, q, inner in chains:
            spans = [slice(begin[k], begin[k] + many[k]) for k in (p, q)]
            _add_chain(score, rows[p], rows[q], np.array(inner), lo[p], weight[lo[p] : lo[p] + many[p]], weight_s, [depth[s] for s in spans], [every[s] for s in spans], [wanted[s] for s in spans])
        delta = np.zeros(len(front))
        for (owner, child), (front, base, paths), (below, base_below, paths_below) in zip(reversed(links), reversed(levels[:-1]), reversed(levels[1:])):
            if len(below):
                score += np.bincount(below, weights=delta, minlength=n)
            delta = paths * np.bincount(owner, weights=((wanted[below + base_below] + delta) / paths_below)[child], minlength=len(front))
    return score


def _add_chain(score: np.ndarray, u: int, v: int, inner: np.ndarray, lo: int, weight: np.ndarray, weight_s: np.ndarray, depth: list[np.ndarray], paths: list[np.ndarray], wanted: list[np.ndarray]) -> None:
    """Adds the nodes within a chain from ``u`` to ``v`` as sources: what they reach through either
    end to ``wanted`` of that end's search, the share of the chain's own nodes to ``score``."""
    length, z = len(inner) + 1, inner - lo
    s, w = weight_s[inner], weight[z]
    other = weight.copy()
    other[z] = 0  # the chain's own nodes are targets further down
    # the i-th node goes by u where a target is nearer to u by more than 2 i - length
    nearer = depth[1] - depth[0] + length
    share = paths[0] / (paths[0] + paths[1])  # where both ways are as long
    turn = 2 * np.arange(1, length)
    even = np.zeros(2 * length + 1)
    even[turn] = s
    up_to = np.cumsum(even)
    by_u, by_v = other * ((up_to - even)[nearer] + even[nearer] * share), other * ((s.sum() - up_to)[nearer] + even[nearer] * (1 - share))
    wanted[0] += by_u
    wanted[1] += by_v
    score[u] += by_u.sum() - by_u[u - lo]
    score[v] += by_v.sum() - by_v[v - lo]
    mass = np.cumsum(np.bincount(nearer, weights=other, minlength=2 * length + 1))
    equal = np.bincount(nearer, weights=other * share, minlength=2 * length + 1)[turn]
    to_u, to_v = s * (mass[-1] - mass[turn] + equal), s * (mass[turn] - equal)
    score[inner] += to_u.sum() - np.cumsum(to_u) + np.cumsum(to_v) - to_v
    # pairs within the chain: along it up to half the way around, else out at both ends
    n, k = len(inner), np.arange(len(inner))
    around = length + int(depth[0][v - lo])
    sums, sums_s = np.r_[0, np.cumsum(w)], np.r_[0, np.cumsum(s)]
    pairs = lambda a, b: s * (sums[b] - sums[a]) + w * (sums_s[b] - sums_s[a])
    ahead, behind = pairs(k + 1, np.minimum(k + 1 + (around - 1) // 2, n)), pairs(np.maximum(k - (around - 1) // 2, 0), k)
    half = around // 2
    if around % 2 == 0 and half < n:
        even = (s[:-half] * w[half:] + s[half:] * w[:-half]) / (1 + paths[0][v - lo])
        ahead[:-half] += even
        behind[half:] += even
    out, out_back = pairs(k + 1, n) - ahead, pairs(0, k) - behind
    score[inner] += np.cumsum(ahead) - ahead - np.cumsum(behind) + out.sum() - np.cumsum(out) + np.cumsum(out_back) - out_back
    score[[u, v]] += out.sum()
    wanted[0][v - lo] += out.sum()


def _joined_betweenness(both: DataFrame, sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Level-wise counting of paths forward and of dependencies backward, keyed by source."""
    first = sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths"))
    levels = [scratch.keep(first, "level")]
    seen = levels[0].select("source", "node")
    while True:
        step = levels[-1].join(both, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        fresh = scratch.keep(step.join(seen, ["source", "node"], "left_anti"), "level")
        if fresh.isEmpty():
            break
        levels.append(fresh)
        # a neighbour of a level lies in the level before it, in it, or after it
        seen = levels[-2].select("source", "node").unionByName(fresh.select("source", "node"))
    dependency = levels[-1].select("source", "node", "paths", F.lit(0.0).alias("delta"))
    every = [dependency]
    for upper in reversed(levels[:-1]):
        below = dependency.select("source", F.col("node").alias("child"), F.col("paths").alias("p"), F.col("delta").alias("d"))
        links = upper.join(both, F.col("node") == F.col("src")).select("source", "node", "paths", F.col("dst").alias("child"))
        gain = links.join(below, ["source", "child"]).groupBy("source", "node").agg(F.sum(F.col("paths") / F.col("p") * (1 + F.col("d"))).alias("delta"))
        dependency = scratch.keep(upper.join(gain, ["source", "node"], "left").select("source", "node", "paths", F.coalesce("delta", F.lit(0.0)).alias("delta")), "delta")
        every.append(dependency)
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out.where("source <> node").groupBy("node").agg(F.sum("delta").alias("score"))


def bridge_flags(scores: DataFrame, part: float = 0.95) -> DataFrame:
    """Nodes at or above the given percentile of the score."""
    cut = scores.agg(F.percentile("score", part).alias("cut"))
    return scores.crossJoin(F.broadcast(cut)).select("node", "score", (F.col("score") >= F.col("cut")).alias("is_bridge"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes.join(ends, "node", "left_anti")


def pairs_within(rows: DataFrame, key: str, order: list[str], distance: int, bucket: Column | None = None) -> DataFrame:
    """(key, a, b, gap): rows at most ``distance`` places apart in their key's order.  ``bucket``
    cuts keys that may be large (see ``sequence``)."""
    ahead = following(rows, key, F.lit(0) if bucket is None else bucket, order, distance, ["id"], "_ahead")
    return ahead.select(key, F.col("id").alias("a"), F.posexplode("_ahead").alias("gap", "n")).select(key, "a", (F.col("gap") + 1).alias("gap"), F.col("n.id").alias("b"))


def decompose_episodes(turns: DataFrame) -> DataFrame:
    """Graph edges of turns: (src, dst, edge_type, weight) for session, time, speaker, entity,
    emotion, intent, project and the previous turn.  ``turns(id, session_id, role, created_at,
    project_id, entities, emotion struct<label,intensity>, intent)``."""
    from palimpsest.functions.text import slug, time_context

    clock = time_context(F.col("created_at"))
    t = turns.withColumn("_time", F.concat_ws(":", clock["year_week"], clock["day_of_week"], clock["time_of_day"]))
    edge = lambda dst, kind, weight: F.struct(dst.alias("dst"), F.lit(kind).alias("edge_type"), weight.cast("double").alias("weight"))
    single = F.array(
        F.when(F.col("session_id").isNotNull(), edge(F.concat(F.lit("session:"), "session_id"), "OCCURRED_IN", F.lit(1.0))),
        F.when(F.col("created_at").isNotNull(), edge(F.concat(F.lit("time:"), "_time"), "OCCURRED_AT", F.lit(0.5))),
        F.when(F.col("role").isNotNull(), edge(F.concat(F.lit("person:"), "role"), "SPOKE", F.lit(0.7))),
        F.when(F.col("emotion.label") != "neutral", edge(F.concat(F.lit("emotion:"), F.col("emotion.label")), "EMOTIONAL", F.col("emotion.intensity"))),
        F.when(F.col("intent").isNotNull(), edge(F.concat(F.lit("intent:"), "intent"), "INTENTIONAL", F.lit(0.5))),
        F.when(F.col("project_id").isNotNull(), edge(F.concat(F.lit("project:"), "project_id"), "PROJECT", F.lit(1.0))),
        F.when(F.col("_previous").isNotNull(), edge(F.col("_previous"), "TEMPORAL", F.lit(0.8))),
    )
    entities = F.transform(F.coalesce("entities", F.array().cast("array<string>")), lambda e: edge(F.concat(F.lit("entity:"), slug(e)), "CONTEXTUAL", F.lit(0.6)))
    t = preceding(t, "session_id", day_bucket("created_at"), ["created_at", "id"], 1, ["id"], "_p").withColumn("_previous", F.when(F.col("session_id").isNotNull(), F.get("_p", F.lit(0))["id"]))
    return t.select(F.col("id").alias("src"), F.explode(F.array_compact(F.concat(single, entities))).alias("e")).select("src", "e.dst", "e.edge_type", "e.weight").groupBy("src", "dst", "edge_type").agg(F.max("weight").alias("weight"))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """(node, label, count): every node with its label from its prefix and its edge count."""
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst"))
    label = F.when(F.instr("node", ":") > 0, F.substring_index("node", ":", 1)).otherwise("memory")
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("activation_count")).withColumn("label", label)
