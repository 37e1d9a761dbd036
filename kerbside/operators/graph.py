"""Street graphs: edges(edge_id, from_id, to_id, length_m).

Operators work in rounds and write each to the shared checkpoint folder. A task holds one block of the graph, never the
whole: searches, paths and walks go on within their block and are handed to the next one where they leave it.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage in spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A session on one machine (local master) that leaves it unset gets a temporary folder; on a
    cluster that is an error, as no local folder is shared."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = f"file://{tempfile.mkdtemp(prefix='kerbside-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def adjacency(edges: DataFrame, *costs: str) -> DataFrame:
    """Both directions: src, dst, edge_id, costs."""
    there = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "edge_id", *costs)
    return there.unionByName(edges.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), "edge_id", *costs))


#: Edges of mean cost that a search for a goal goes at first.
FIRST_EDGES = 6
#: Nodes of a block by default: ids that follow each other.
BLOCK_NODES = 1024


def _blocked(rows: DataFrame, blocks: DataFrame | None, node: str, name: str) -> DataFrame:
    """rows with the block of a node."""
    if blocks is None:
        return rows.withColumn(name, F.floor(F.col(node) / BLOCK_NODES).cast("long"))
    return rows.join(blocks.select(F.col("node_id").alias(node), F.col("block").cast("long").alias(name)), node)


def reach(edges: DataFrame, sources: DataFrame, budget: float, cost: str = "length_m", blocks: DataFrame | None = None, salts: int = 1, most_rounds: int = 10_000, seen: list | None = None) -> DataFrame:
    """(source, node_id, cost): least cost from each source(source, node_id) to the nodes within budget.

    By local expansion: nodes lie in blocks(node_id, block), cells of a map for instance, else runs of ids. A round settles
    each block that was entered: a heap search from the entries through the block's own edges, which hands costs on to the
    blocks beyond. So rounds follow how many blocks a path crosses, not how many edges it has. Only what became cheaper is
    written, once, and only entries move between blocks. A task holds a block's edges and the costs of the sources that have
    reached it, which `salts` deals out. `seen` gets the number of entries of each round."""
    return _expanded(edges, sources, budget, cost, blocks, salts, most_rounds, seen).groupBy("source", "node_id").agg(F.min("cost").alias("cost"))


def _expanded(edges: DataFrame, sources: DataFrame, budget: float, cost: str, blocks: DataFrame | None, salts: int, most_rounds: int, seen: list | None = None, goals: DataFrame | None = None) -> DataFrame:
    """(block, source, node_id, cost, prev, came): every cost that was the least of its round; prev is the node before, came
    that node's block (a source's own node has itself). With goals(source, node_id) a source's search ends where nothing
    ahead is cheaper than its goal; until that is found it goes no further than a limit, which doubles when all up to it is
    settled, so that it visits what lies about as near as its goal and not whole blocks."""
    adj = _blocked(_blocked(adjacency(edges, cost), blocks, "src", "block"), blocks, "dst", "to_block")
    adj = checkpointed(adj.select("block", "src", "dst", "to_block", F.col(cost).cast("double").alias("c")))
    salt = lambda df: df.withColumn("salt", F.pmod(F.hash("source"), F.lit(salts)))
    dealt = adj.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    source, node = sources.schema["source"].dataType.simpleString(), sources.schema["node_id"].dataType.simpleString()
    columns = ["block", "source", "node_id", "cost", "entry", "prev", "came", "upto"]
    ddl = f"block long, source {source}, node_id {node}, cost double, entry boolean, prev {node}, came long"
    if goals is None:
        first = budget
    else:
        first = FIRST_EDGES * (adj.agg(F.avg("c")).first()[0] or 0.0)

    def settle(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        around: dict = {}
        for a, b, to, c in zip(own["src"].tolist(), own["dst"].tolist(), own["to_block"].tolist(), own["c"].tolist(), strict=True):
            around.setdefault(a, []).append((b, to, c))
        out = []
        for start, some in rows.groupby("source", sort=False):
            best: dict = {}
            heap = []
            here = int(some["block"].iloc[0])
            upto = float(some["upto"].max())
            for n, c, entry, prev, came in zip(*(some[x].tolist() for x in columns[2:7]), strict=True):
                if entry:
                    heap.append((c, n, prev, came))
                else:
                    best[n] = min(c, best.get(n, np.inf))
            heapq.heapify(heap)
            better, ahead = {}, {}
            while heap:
                c, n, prev, came = heapq.heappop(heap)
                if c >= best.get(n, np.inf):
                    continue
                if c > upto:  # held for a later round
                    ahead[here, n] = min((c, prev, came), ahead.get((here, n), (np.inf, prev, came)))
                    continue
                best[n] = c
                better[n] = c, prev, came
                for m, to, step in around.get(n, ()):
                    d = c + step
                    if d <= budget:
                        if to != here:
                            ahead[to, m] = min((d, n, here), ahead.get((to, m), (np.inf, n, here)))
                        elif d < best.get(m, np.inf):
                            heapq.heappush(heap, (d, m, n, here))
            out += [(here, start, n, c, False, prev, came) for n, (c, prev, came) in better.items()]
            out += [(to, start, n, c, True, prev, came) for (to, n), (c, prev, came) in ahead.items()]
        return pd.DataFrame(out, columns=columns[:7])

    own = _blocked(sources.select("source", "node_id"), blocks, "node_id", "block")
    entries = checkpointed(own.select("block", "source", "node_id", F.lit(0.0).alias("cost"), F.lit(True).alias("entry"), F.col("node_id").alias("prev"), F.col("block").alias("came"), F.lit(float(first)).alias("upto")))
    known = None
    for _ in range(most_rounds):
        held = entries.where("cost > upto").drop("upto")
        entries = entries.where("cost <= upto")
        entered = entries.select("block").distinct()
        rows = entries.select(*columns)
        if known is not None:
            rows = rows.unionByName(known.join(entries.groupBy("block", "source").agg(F.max("upto").alias("upto")), ["block", "source"]))
        mine = dealt.join(entered, "block", "left_semi")
        out = checkpointed(salt(rows).groupBy("block", "salt").cogroup(mine.groupBy("block", "salt")).applyInPandas(settle, ddl))
        settled_ = out.where("NOT entry")
        known = settled_ if known is None else known.unionByName(settled_)
        left = out.where("entry") if goals is None else out.where("entry").unionByName(held)
        entries = left.groupBy("block", "source", "node_id", "entry").agg(F.min(F.struct("cost", "prev", "came")).alias("e")).select("block", "source", "node_id", "entry", "e.*")
        if goals is not None:
            bound = known.join(goals, ["source", "node_id"]).groupBy("source").agg(F.min("cost").alias("bound"))
            limit = entries.join(bound, "source", "left").where("bound IS NULL OR cost < bound")
            grown = F.greatest(F.lit(float(first)), 2 * F.min("cost").over(Window.partitionBy("source")))
            # entries up to the goal's cost are all that is left of a search that has found it
            entries = checkpointed(limit.withColumn("upto", F.coalesce("bound", grown)).drop("bound"))
        else:
            entries = entries.withColumn("upto", F.lit(float(first)))
        n = entries.count()
        if seen is not None:
            seen.append(n)
        if not n:
            return known.drop("entry")
    raise RuntimeError("the search did not settle")


def isochrone_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(source, edge_id) of edges with both ends reached."""
    a = reached.select("source", F.col("node_id").alias("from_id"))
    b = reached.select("source", F.col("node_id").alias("to_id"))
    return edges.join(a, "from_id").join(b, ["source", "to_id"]).select("source", "edge_id")


def components(nodes: DataFrame, links: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(node_id, component): the smallest node_id reachable over links(a, b).

    The links of a batch become stars on their smallest nodes within its task: few rows are left. Then each round stars every
    node's larger neighbours on its smallest one, and its smaller ones after that, so rounds grow as the logarithm of a
    component's width."""
    edges = checkpointed(links.where("a <> b").select("a", "b").mapInPandas(_stars, "a long, b long"))
    for _ in range(most_rounds):
        if settled(edges):
            return nodes.select("node_id").join(edges, F.col("node_id") == F.col("a"), "left").select("node_id", F.coalesce("b", "node_id").alias("component"))
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = checkpointed(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    raise RuntimeError("components did not settle")


def settled(edges: DataFrame) -> bool:
    """Whether edges(a, b) are stars: each a has one b, which is no other's a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def _stars(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        up: dict[int, int] = {}

        def root(x: int, up: dict[int, int] = up) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for a, b in zip(part["a"].tolist(), part["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        rows = [(x, root(x)) for x in list(up)]
        yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"], dtype="int64")


def shortest_paths(pairs: DataFrame, edges: DataFrame, cost: str = "length_m", penalty: str | None = None, blocks: DataFrame | None = None, salts: int = 1, most_rounds: int = 10_000) -> DataFrame:
    """(pair_id, seq, edge_id, cost, total): the edges of the cheapest path of each pairs(pair_id, start, goal); pair_id is unique.

    The search weighs an edge by cost * penalty, the result counts cost alone. Costs spread from the starts as in `reach`, and
    no further than the goal's own; then each path is followed back from its goal through the nodes before, within a block at
    a time. Unreachable pairs and those that end where they start have no rows."""
    weighed = edges.select("edge_id", "from_id", "to_id", F.col(cost).cast("double").alias("c"), (F.col(cost) * (F.col(penalty) if penalty else F.lit(1.0))).alias("w"))
    sources, goals = (pairs.select(F.col("pair_id").alias("source"), F.col(c).alias("node_id")) for c in ("start", "goal"))
    found = _expanded(weighed, sources, float("inf"), "w", blocks, salts, most_rounds, goals=goals)
    tree = found.groupBy("block", "source", "node_id").agg(F.min(F.struct("cost", "prev", "came")).alias("t")).select("block", "source", "node_id", "t.prev", "t.came")
    tree = checkpointed(tree)
    node = pairs.schema["goal"].dataType.simpleString()
    ddl = f"source {pairs.schema['pair_id'].dataType.simpleString()}, back long, node_id {node}, prev {node}, block long, head boolean"

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        """The steps of one path in one block, from where it leaves it to where it enters it, and the head beyond."""
        here, source = int(rows["block"].iloc[0]), rows["source"].iloc[0]
        before = {n: (p, b) for n, p, b, head in zip(rows["node_id"].tolist(), rows["prev"].tolist(), rows["came"].tolist(), rows["head"].tolist(), strict=True) if not head}
        out = []
        for n, k in rows.loc[rows["head"], ["node_id", "back"]].itertuples(index=False):
            block = here
            while block == here and n in before and before[n][0] != n:
                prev, block = before[n]
                out.append((source, k, n, prev, here, False))
                n, k = prev, k + 1
            if block != here:
                out.append((source, k, n, n, block, True))
        return pd.DataFrame(out, columns=["source", "back", "node_id", "prev", "block", "head"])

    heads = tree.join(goals, ["source", "node_id"]).select("block", "source", "node_id", F.lit(0).cast("long").alias("back"), "prev", "came", F.lit(True).alias("head"))
    steps = None
    for _ in range(most_rounds):
        own = tree.join(heads.select("block", "source"), ["block", "source"], "left_semi").select("block", "source", "node_id", F.lit(0).cast("long").alias("back"), "prev", "came", F.lit(False).alias("head"))
        out = checkpointed(own.unionByName(heads).groupBy("block", "source").applyInPandas(follow, ddl))
        some = out.where("NOT head").select("source", "back", "node_id", "prev")
        steps = some if steps is None else steps.unionByName(some)
        heads = out.where("head").select("block", "source", "node_id", "back", "prev", F.col("block").alias("came"), "head")
        if heads.isEmpty():
            break
    # the lightest edge between two neighbours is the one that was taken
    taken = adjacency(weighed, "c", "w").groupBy("src", "dst").agg(F.min(F.struct("w", "edge_id", "c")).alias("e"))
    path = steps.join(taken, (F.col("prev") == F.col("src")) & (F.col("node_id") == F.col("dst")))
    one = Window.partitionBy("source")  # a path
    return path.select(
        F.col("source").alias("pair_id"),
        (F.max("back").over(one) - F.col("back")).alias("seq"),
        F.col("e.edge_id").alias("edge_id"),
        F.col("e.c").alias("cost"),
        F.sum("e.c").over(one).alias("total"),
    )


def draw(seed: int, walk: int, step: int, n: int) -> int:
    """One of n places for a step of a walk: the first 32 bits of an MD5 of all three, spread over n."""
    return int(hashlib.md5(f"{seed}:{walk}:{step}".encode()).hexdigest()[:8], 16) * n >> 32


def random_walks(starts: DataFrame, edges: DataFrame, steps: int, seed: int, blocks: DataFrame | None = None, salts: int = 1) -> DataFrame:
    """(walk_id, step, node_id, edge_id): uniform steps from starts(walk_id, node_id) over incident edges, in the order of their
    ids, without turning back where another edge exists. A step depends on seed, walk and step alone (`draw`), so walks are the
    same however the graph is cut. A round takes each walk on until it leaves its block; salts deals a block's walks out."""
    adj = checkpointed(_blocked(_blocked(adjacency(edges), blocks, "src", "block"), blocks, "dst", "to_block").select("block", "src", "dst", "to_block", F.col("edge_id").cast("long").alias("edge_id")))
    dealt = adj.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    columns = ["walk_id", "step", "node_id", "edge_id", "block", "head"]

    def go(heads: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        around: dict[int, list[tuple[int, int, int]]] = {}
        for src, *edge in sorted(zip(*(own[c].tolist() for c in ("src", "edge_id", "dst", "to_block")), strict=True)):
            around.setdefault(src, []).append(tuple(edge))
        out = []
        for walk, k, node, last, here in zip(*(heads[c].tolist() for c in columns[:5]), strict=True):
            block = here
            while k < steps and block == here and (found := around.get(node)):
                ahead = [x for x in found if x[0] != last] or found
                k += 1
                last, node, block = ahead[draw(seed, walk, k, len(ahead))]
                out.append((walk, k, node, last, block, False))
            if block != here and k < steps:
                out.append((walk, k, node, last, block, True))
        return pd.DataFrame(out, columns=columns)

    own = _blocked(starts.select(F.col("walk_id").cast("long").alias("walk_id"), "node_id"), blocks, "node_id", "block")
    # no edge has the id -1 here: nothing to turn back on yet
    heads = checkpointed(own.select("walk_id", F.lit(0).cast("long").alias("step"), F.col("node_id").cast("long").alias("node_id"), F.lit(-1).cast("long").alias("edge_id"), "block"))
    walked = heads.select(*columns[:3], F.lit(None).cast("long").alias("edge_id"))
    while not heads.isEmpty():
        mine = dealt.join(heads.select("block").distinct(), "block", "left_semi")
        at = heads.withColumn("salt", F.pmod(F.hash("walk_id"), F.lit(salts)))
        out = checkpointed(at.groupBy("block", "salt").cogroup(mine.groupBy("block", "salt")).applyInPandas(go, "walk_id long, step long, node_id long, edge_id long, block long, head boolean"))
        walked = walked.unionByName(out.where("NOT head").select(*columns[:4]))
        heads = out.where("head").select(*columns[:5])
    return walked
