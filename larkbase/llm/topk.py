"""Exact top-k search by inner product over cover trees of queries and data.

Vectors become integers, floor(scale * component). Of equal vectors only the k + 1 smallest ids can
matter, and equal queries ask the same, so both are reduced to that before anything else; a vector
that a third of all rows hold is a few rows from then on.

Queries and data are indexed together. A node is a ball around one of its rows, with one covering
radius for its data and one for its queries; a node of more than `block` rows is split among up to
`fan` centres, distant ones among rows drawn from it, each row going to the nearest, and so on until all leaves are small.
The tree gets deeper as the data grow, and rows are never dealt by a hash. For any query q within r
of its node's centre c and any vector v within s of its node's centre d,
    q.v <= c.d + r|d| + s|c| + r s.

Each leaf's queries are first searched in their own leaf, which gives every query group a worst
k-th score. Then the tree is walked in pairs of nodes from the root: only children of pairs whose
bound reaches the worst k-th score of the queries below are looked at further. What is left at the
leaves is searched: within a pair of query group and data block, a cover tree over each side, whose
nodes about halve the radius from level to level, is walked in pairs by the same bound, best bound
first, and leaves are multiplied. The walk handles centres only; the vectors of a leaf travel packed
in one row. The result is exact: bounds are widened beyond rounding, products are exact integers.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part;
vectors of another length than a query are no candidates of it; every row is a row of its own, also
if its id or its vector repeats, and is a candidate of all queries but itself (queries that are given
as another table have no row of their own among the data); null ids are last among ties, which go to
the smaller id; with fewer than k candidates all are returned; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkbase.llm.common import materialize, prepare_python

#: Products are exact in doubles below this.
EXACT = float(1 << 53)
#: Radii are widened by this share, beyond the rounding of distances.
WIDER = 1 + 1e-9
DATA, QUERY = 1, 2
#: Stands for a null id in comparisons, where it is last; a negative row number tells that it does.
NO_ID = (1 << 63) - 1


@dataclass
class TopKConfig:
    k: int = 10
    scale: int = 1024
    #: Most children of a node.
    fan: int = 64
    #: Most vectors of a leaf or block, and most queries of a group.
    block: int = 4096
    group: int = 256
    #: Groups that one task asks a block for.
    groups_of_task: int = 512
    #: Rows of a leaf within a block's or group's own tree.
    leaf: int = 256
    #: Bytes of centres of one level that are sent to all executors; more are joined by sorting.
    sent_centres: int = 64 << 20
    #: Rows of node tables (about 40 bytes) that are sent to all executors.
    sent_nodes: int = 500_000
    #: Rows that one task gives to the centres of a node, where these are joined by sorting.
    rows_of_task: int = 500_000


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def numbered(vectors: DataFrame, queries: DataFrame | Column, scale: int) -> DataFrame:
    """(row, id, kind, v, a, b): a row number, the id, DATA, QUERY or both, integer components as doubles, and
    two hashes of them."""
    if isinstance(queries, Column):
        asked = F.when(queries, F.lit(DATA | QUERY)).otherwise(F.lit(DATA))
        both = vectors.select(F.col("id").cast("long").alias("id"), "vector", asked.alias("kind"))
    else:
        both = vectors.select(F.col("id").cast("long").alias("id"), "vector", F.lit(DATA).alias("kind")).unionByName(
            queries.select(F.col("id").cast("long").alias("id"), "vector", F.lit(QUERY).alias("kind"))
        )
    whole = both.filter(usable(F.col("vector"))).withColumn("v", F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("double")))
    return materialize(
        whole.select(F.monotonically_increasing_id().alias("row"), "id", "kind", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(7), "v").alias("b"))
    )


def candidates_and_questions(rows: DataFrame, k: int) -> DataFrame:
    """(kind, x, y, v): of equal vectors the rows with the k + 1 least ids, as DATA with x the id and y the row
    (negative without an id); and the distinct vectors asked, as QUERY with x and y their hashes."""
    known = F.col("id").isNotNull()
    data = rows.filter(F.col("kind").bitwiseAND(DATA) != 0).select(
        F.coalesce("id", F.lit(NO_ID)).alias("x"), F.when(known, F.col("row")).otherwise(-F.col("row") - 1).alias("y"), "v"
    )
    # Spark limits each key's rows before they are shuffled.
    order = Window.partitionBy("v").orderBy("x", "y")
    data = data.withColumn("copy", F.row_number().over(order)).filter(F.col("copy") <= k + 1)
    asked = rows.filter(F.col("kind").bitwiseAND(QUERY) != 0).groupBy("a", "b").agg(F.first("v").alias("v"))
    return data.select(F.lit(DATA).alias("kind"), "x", "y", "v").unionByName(
        asked.select(F.lit(QUERY).alias("kind"), F.col("a").alias("x"), F.col("b").alias("y"), "v")
    )


# ---------------------------------------------------------------- the tree of all rows


def matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and the distance to it."""
    at = ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
    return at, np.sqrt(((x - centres[at]) ** 2).sum(axis=1)) * WIDER


def _given(batch: pa.RecordBatch, centres_of) -> Iterator[pa.RecordBatch]:
    """The rows with the child node they belong to and their distance from its centre."""
    nodes = batch.column("node").dictionary_encode()
    codes = nodes.indices.to_numpy(zero_copy_only=False)
    for code, node in enumerate(nodes.dictionary.to_pylist()):
        own = batch.take(pa.array(np.flatnonzero(codes == code)))
        at, far = nearest(matrix(own.column("v")), centres_of(node))
        yield pa.RecordBatch.from_arrays(
            [*(own.column(c) for c in ("kind", "x", "y", "v")), pa.array([f"{node}.{i}" for i in at.tolist()], pa.string()), pa.array(far)],
            ["kind", "x", "y", "v", "node", "far"],
        )


PLACED = "kind int, x long, y long, v array<double>, node string, far double"


def give(rows: DataFrame, centres: DataFrame, config: TopKConfig) -> DataFrame:
    """Rows of nodes that are split, in the child nodes of the nearest centre. `centres` has (node, n, centres)."""
    spark = rows.sparkSession
    prepare_python(spark)
    size = centres.agg(F.sum(F.size("centres") * F.size(F.col("centres")[0]) * 8)).first()[0]
    if size <= config.sent_centres:
        found = centres.select("node", "centres").toArrow().to_pylist()
        shared = spark.sparkContext.broadcast({r["node"]: np.array(r["centres"]) for r in found})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _given(batch, shared.value.__getitem__)

        return rows.select("kind", "x", "y", "v", "node").mapInArrow(run, PLACED)

    # A node's centres come before its rows in a sorted stream; a node of many rows is dealt to several tasks.
    tasks = F.ceil(F.col("n") / config.rows_of_task).cast("int")
    none = F.lit(None)
    first = centres.select(
        "node", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("deal"), F.lit(0).alias("kind"), none.cast("long").alias("x"), none.cast("long").alias("y"),
        none.cast("array<double>").alias("v"), "centres",
    )
    rest = rows.join(centres.select("node", tasks.alias("tasks")), "node").select(
        "node", F.pmod(F.xxhash64("x", "y"), "tasks").cast("int").alias("deal"), "kind", "x", "y", "v", none.cast("array<array<double>>").alias("centres")
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            leads = batch.column("kind").to_numpy() == 0
            new = {batch.column("node")[i].as_py(): np.array(batch.column("centres")[i].as_py()) for i in np.flatnonzero(leads).tolist()}
            held |= new
            if not leads.all():
                own = batch.filter(pa.array(~leads))
                yield from _given(own, held.__getitem__)
                last = own.column("node")[own.num_rows - 1].as_py()
                held = {n: c for n, c in held.items() if n == last or n in new}

    return first.unionByName(rest).repartition("node", "deal").sortWithinPartitions("node", "deal", "kind").mapInArrow(stream, PLACED)


def farthest_first(x: np.ndarray, wanted: int) -> np.ndarray:
    """So many of the vectors, each as far from those before it as any is."""
    picked, near = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < min(wanted, len(x)):
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked]


def spread_out(drawn: DataFrame) -> DataFrame:
    """(node, n, centres) with `wanted` of the centres that were drawn for each node."""
    prepare_python(drawn.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("centres").to_pylist(), batch.column("wanted").to_pylist(), strict=True)
            made = [farthest_first(np.array(c), w).tolist() for c, w in rows]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(made, pa.list_(pa.list_(pa.float64())))], ["node", "n", "centres"])

    return drawn.select("node", F.col("n").cast("long").alias("n"), F.col("wanted").cast("long").alias("wanted"), "centres").mapInArrow(run, "node string, n long, centres array<array<double>>")


@dataclass
class Tree:
    #: (node, parent, level, centre, norm, n_data, n_query, r_data, r_query, is_leaf)
    nodes: DataFrame
    #: (kind, x, y, v, node) with the leaf of each row
    rows: DataFrame
    depth: int


def small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def build(rows: DataFrame, config: TopKConfig) -> Tree:
    """The tree over candidates and questions. Each level reads only the rows of nodes that are split."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    placed = materialize(rows.withColumns({"node": F.size("v").cast("string"), "far": norm * WIDER}))
    centres = placed.groupBy("node").agg(F.array_repeat(F.lit(0.0), F.max(F.size("v"))).alias("centre"))
    nodes, done, level = [], [], 0
    while True:
        of = lambda kind, made: made(F.when(F.col("kind") == kind, F.col("far")))
        info = placed.groupBy("node").agg(
            of(DATA, F.count).alias("n_data"), of(QUERY, F.count).alias("n_query"), of(DATA, F.max).alias("r_data"), of(QUERY, F.max).alias("r_query")
        )
        info = materialize(info.join(centres, "node").withColumn("level", F.lit(level)))
        n = F.col("n_data") + F.col("n_query")
        # As many centres as leaves are needed, the most distant of four times as many that a hash draws.
        big = info.filter(n > config.block).select("node", n.alias("n"), F.greatest(F.lit(2), F.least(F.lit(config.fan), F.ceil(n / config.block))).alias("wanted"))
        draw = F.pmod(F.xxhash64("x", "y", F.lit(level)), F.lit(1 << 30))
        sampled = placed.join(small(big, config.sent_nodes), "node").filter(draw * F.col("n") < F.col("wanted") * (4 << 30)).select("node", "n", "wanted", "v", "x", "y", draw.alias("draw"))
        first = Window.partitionBy("node").orderBy("draw", "x", "y")
        chosen = sampled.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= 4 * F.col("wanted"))
        drawn = chosen.groupBy("node").agg(F.max("n").alias("n"), F.max("wanted").alias("wanted"), F.array_distinct(F.collect_list("v")).alias("centres"))
        split = materialize(spread_out(drawn.filter(F.size("centres") > 1)))
        parents = small(split.select("node"), config.sent_nodes)
        nodes.append(info.join(parents.withColumn("has", F.lit(True)), "node", "left").withColumn("is_leaf", F.col("has").isNull()).drop("has"))
        if split.isEmpty():
            done.append(placed)
            break
        done.append(placed.join(parents, "node", "left_anti"))
        placed = materialize(give(placed.join(parents, "node", "left_semi"), split, config))
        centres = split.select("node", F.posexplode("centres").alias("i", "centre")).select(F.concat_ws(".", "node", F.col("i").cast("string")).alias("node"), "centre")
        level += 1
    parent = F.when(F.col("level") > 0, F.regexp_replace("node", r"\.\d+$", ""))
    norm = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda a, x: a + x * x))
    whole = reduce(DataFrame.unionByName, nodes).withColumns({"parent": parent, "norm": norm})
    return Tree(materialize(whole), reduce(DataFrame.unionByName, done).select("kind", "x", "y", "v", "node"), level)


def pack(tree: Tree, kind: int, size: int, config: TopKConfig) -> DataFrame:
    """(part, node, length, n, xs, ys, packed): the rows of one kind of each leaf, in parts of about `size`."""
    prepare_python(tree.rows.sparkSession)
    count = "n_data" if kind == DATA else "n_query"
    leaves = tree.nodes.filter("is_leaf").select("node", F.ceil(F.col(count) / size).cast("int").alias("parts")).filter("parts > 0")
    rows = tree.rows.filter(F.col("kind") == kind).join(small(leaves, config.sent_nodes), "node")
    rows = rows.select("node", F.pmod(F.xxhash64("x", "y"), "parts").cast("int").alias("i"), "x", "y", "v")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["v"].to_list()).astype("<f8")
        first = frame.iloc[0]
        made = {"part": f"{first['node']}/{first['i']}", "node": first["node"], "i": int(first["i"]), "length": x.shape[1], "n": len(x)}
        return pd.DataFrame({k: [v] for k, v in made.items()} | {"xs": [frame["x"].to_numpy(np.int64).tobytes()], "ys": [frame["y"].to_numpy(np.int64).tobytes()], "packed": [x.tobytes()]})

    return materialize(rows.groupBy("node", "i").applyInPandas(run, "part string, node string, i int, length int, n int, xs binary, ys binary, packed binary"))


# ---------------------------------------------------------------- within a pair of group and block


@dataclass
class Node:
    rows: np.ndarray
    centre: np.ndarray
    radius: float
    norm: float
    children: list[Node]


def cover_tree(points: np.ndarray, rows: np.ndarray, leaf: int) -> Node:
    """A tree whose nodes cover their rows within a radius about half that of the node above."""
    own = points[rows]
    centre = own[0]
    far = np.sqrt(((own - centre) ** 2).sum(axis=1))
    radius = float(far.max())
    node = Node(rows, centre, radius * WIDER, float(np.sqrt(centre @ centre)), [])
    if len(rows) <= leaf or radius == 0:
        return node
    # Children: centres picked farthest-first until the rest lies within half the radius.
    owner, near = np.zeros(len(rows), dtype=np.int64), far
    picked = 1
    while near.max() > radius / 2 and picked < 16:
        at = int(near.argmax())
        distance = np.sqrt(((own - own[at]) ** 2).sum(axis=1))
        closer = distance < near
        owner[closer], near = picked, np.where(closer, distance, near)
        picked += 1
    for c in range(picked):
        part = rows[owner == c]
        if len(part) == len(rows):
            return node
        if len(part):
            node.children.append(cover_tree(points, part, leaf))
    return node


def bound(q: Node, p: Node) -> float:
    value = float(q.centre @ p.centre) + q.radius * p.norm + p.radius * q.norm + q.radius * p.radius
    return value + 1e-6 * (1 + abs(value))


class Best:
    """The best `most` (score, x, y) of each query so far; what was found is sorted in when there is enough of it."""

    def __init__(self, most: int, floor: np.ndarray):
        self.most, self.worst = most, floor.copy()
        self.held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)]
        self.fresh: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def offer(self, rows: np.ndarray, scores: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> None:
        """Scores of the queries `rows` with vectors."""
        at, to = np.nonzero(scores >= self.worst[rows][:, None])
        if len(at):
            self.fresh.append((rows[at], scores[at, to], xs[to], ys[to]))
            self.waiting += len(at)
            if self.waiting > 2 * self.most * len(self.worst):
                self.sort_in()

    def sort_in(self) -> None:
        if not self.fresh:
            return
        row, score, x, y = (np.concatenate([h, *f]) for h, f in zip(self.held, zip(*self.fresh, strict=True), strict=True))
        # Python integers are sorted as such.
        by = np.lexsort((y, x, -score, row)) if score.dtype != object else sorted(range(len(row)), key=lambda i: (row[i], -score[i], x[i], y[i]))
        row, score, x, y = row[by], score[by], x[by], y[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        full = rank == self.most - 1
        self.worst[row[full]] = np.maximum(self.worst[row[full]], score[full].astype(float))
        keep = rank < self.most
        self.held, self.fresh, self.waiting = [row[keep], score[keep], x[keep], y[keep]], [], 0


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products as doubles, or as Python integers where doubles could round."""
    if q.size and p.size and np.abs(q).max() * np.abs(p).max() * q.shape[1] >= EXACT:
        return np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in p] for x in q], dtype=object)
    return q @ p.T


@dataclass
class Side:
    """The rows of a group or block, with their own tree."""

    points: np.ndarray
    xs: np.ndarray
    ys: np.ndarray
    tree: Node

    @classmethod
    def of(cls, row: dict, leaf: int) -> Side:
        points = np.frombuffer(row["packed"], "<f8").reshape(-1, row["length"])
        return cls(points, np.frombuffer(row["xs"], np.int64), np.frombuffer(row["ys"], np.int64), cover_tree(points, np.arange(len(points)), leaf))


def search(q: Side, p: Side, floor: np.ndarray, most: int) -> Best:
    """Dual-tree search of one group of queries in one block."""
    best, serial = Best(most, floor), 0
    heap = [(-bound(q.tree, p.tree), serial, q.tree, p.tree)]
    while heap:
        minus, _, a, b = heapq.heappop(heap)
        if -minus < best.worst[a.rows].min():
            continue
        if not a.children and not b.children:
            best.offer(a.rows, products(q.points[a.rows], p.points[b.rows]), p.xs[b.rows], p.ys[b.rows])
            continue
        # The wider node is opened.
        pairs = [(c, b) for c in a.children] if a.children and (not b.children or a.radius > b.radius) else [(a, c) for c in b.children]
        for c, d in pairs:
            limit = bound(c, d)
            if limit >= best.worst[c.rows].min():
                serial += 1
                heapq.heappush(heap, (-limit, serial, c, d))
    best.sort_in()
    return best


# ---------------------------------------------------------------- pairs of groups and blocks

FOUND = "part string, q int, qx long, qy long, x long, y long, score long"


def search_pairs(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, floors: DataFrame | None, config: TopKConfig) -> DataFrame:
    """`FOUND`: up to k + 1 candidates of each query from each pair (part, block).

    A block's row comes before the rows of the groups that ask it, in a sorted stream, so its tree is
    built once and a task holds one block. A block that very many groups ask is sent to several tasks.
    """
    prepare_python(pairs.sparkSession)
    most = config.k + 1
    tasks = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / config.groups_of_task).cast("int").alias("tasks"))
    pairs = pairs.join(tasks, "block").select("part", "block", F.pmod(F.xxhash64("part"), "tasks").cast("int").alias("deal"))
    q = groups.select("part", "length", "xs", "ys", "packed")
    q = q.join(floors, "part", "left") if floors is not None else q.withColumn("floors", F.lit(None).cast("map<int,double>"))
    asking = pairs.join(q, "part").select("block", "deal", F.lit(1).alias("kind"), "part", "length", "xs", "ys", "packed", "floors")
    asked = blocks.withColumnRenamed("part", "block").join(tasks, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("deal"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("part"),
        "length", "xs", "ys", "packed", F.lit(None).cast("map<int,double>").alias("floors"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in ("kind", "part", "length", "xs", "ys", "packed", "floors")}
                side = Side.of(row, config.leaf)
                if row["kind"] == 0:
                    block = side
                    continue
                floor = np.full(len(side.xs), -np.inf)
                for i, value in row["floors"] or []:
                    floor[i] = value
                queries, score, x, y = search(side, block, floor, most).held
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(x), pa.string()), pa.array(queries, pa.int32()), pa.array(side.xs[queries]), pa.array(side.ys[queries]),
                        pa.array(x), pa.array(y), pa.array([int(s) for s in score], pa.int64()),
                    ],
                    ["part", "q", "qx", "qy", "x", "y", "score"],
                )

    stream = asked.unionByName(asking).repartition("block", "deal").sortWithinPartitions("block", "deal", "kind")
    return stream.mapInArrow(run, FOUND)


def best_of(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("qx", "qy").orderBy(F.desc("score"), "x", "y")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def first_pairs(tree: Tree, groups: DataFrame, blocks: DataFrame, config: TopKConfig) -> DataFrame:
    """Each group with a block of its own leaf; where that leaf has too few data, also with one of the leaf of
    most data under the same parent."""
    parts = blocks.groupBy(F.col("node").alias("leaf")).agg(F.max("i").alias("last"))
    leaves = tree.nodes.filter("is_leaf")
    home = groups.select("part", "i", F.col("node").alias("leaf"))
    widest = leaves.filter("n_data > 0").groupBy("parent").agg(F.max_by("node", F.struct("n_data", "node")).alias("leaf"))
    beside = groups.select("part", "i", "node").join(leaves.filter(F.col("n_data") <= config.k).select("node", "parent"), "node").join(widest, "parent").select("part", "i", "leaf")
    both = home.unionByName(beside).distinct().join(parts, "leaf")
    return both.select("part", F.concat_ws("/", "leaf", F.pmod("i", F.col("last") + 1).cast("string")).alias("block"))


def walk(tree: Tree, worst: DataFrame) -> DataFrame:
    """(leaf, other): pairs of leaves whose bound reaches the worst k-th score of the queries in `leaf`;
    `worst` has (node, worst) of leaves, null where a query still lacks candidates."""
    nodes = tree.nodes.join(worst, "node", "left")
    # A node's worst score is the least below it, from the deepest level up.
    known = nodes.filter("is_leaf AND n_query > 0").select("node", "parent", "level", "worst")
    levels = [known]
    for level in range(tree.depth, 0, -1):
        below = levels[-1].filter(F.col("level") == level)
        up = below.groupBy(F.col("parent").alias("node")).agg(F.when(F.count("worst") == F.count(F.lit(1)), F.min("worst")).alias("worst"))
        made = tree.nodes.select("node", "parent", "level").join(up, "node")
        levels.append(materialize(levels[-1].unionByName(made)))
    limits = levels[-1].select("node", "worst")
    nodes = materialize(tree.nodes.join(limits, "node", "left"))
    kids = nodes.filter("parent IS NOT NULL").withColumn("of", F.col("parent")).unionByName(nodes.filter("is_leaf").withColumn("of", F.col("node")))
    left = kids.filter("n_query > 0").select(F.col("of").alias("leaf"), F.col("node").alias("a"), F.col("centre").alias("c"), F.col("norm").alias("nc"), F.col("r_query").alias("r"), "worst")
    right = kids.filter("n_data > 0").select(F.col("of").alias("other"), F.col("node").alias("b"), F.col("centre").alias("d"), F.col("norm").alias("nd"), F.col("r_data").alias("s"))
    dot = F.aggregate(F.zip_with("c", "d", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    value = dot + F.col("r") * F.col("nd") + F.col("s") * F.col("nc") + F.col("r") * F.col("s")
    pairs = nodes.filter("parent IS NULL AND n_query > 0 AND n_data > 0").select(F.col("node").alias("leaf"), F.col("node").alias("other"))
    for _ in range(tree.depth):
        reached = F.col("worst").isNull() | (value + 1e-6 * (1 + F.abs(value)) >= F.col("worst"))
        pairs = materialize(pairs.join(left, "leaf").join(right, "other").filter(reached).select(F.col("a").alias("leaf"), F.col("b").alias("other")))
    return pairs


@dataclass
class Search:
    """What is looked at: groups and blocks, the pairs searched first, what these found, and the pairs left."""

    groups: DataFrame
    blocks: DataFrame
    first: DataFrame
    found: DataFrame
    floors: DataFrame
    left: DataFrame


def plan_search(rows: DataFrame, config: TopKConfig) -> Search:
    tree = build(candidates_and_questions(rows, config.k), config)
    groups, blocks = pack(tree, QUERY, config.group, config), pack(tree, DATA, config.block, config)
    first = materialize(first_pairs(tree, groups, blocks, config))
    found = materialize(search_pairs(first, groups, blocks, None, config))
    last = best_of(found, config.k + 1).filter(F.col("rank") == config.k + 1).select("part", "q", F.col("score").cast("double").alias("score"))
    floors = materialize(last.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("q", "score"))).alias("floors"), F.min("score").alias("least"), F.count(F.lit(1)).alias("known")))
    full = groups.select("part", "node", "n").join(floors, "part", "left").select("node", F.when(F.col("known") == F.col("n"), F.col("least")).alias("worst"))
    worst = full.groupBy("node").agg(F.when(F.count("worst") == F.count(F.lit(1)), F.min("worst")).alias("worst"))
    pairs = walk(tree, worst)
    left = (
        pairs.join(groups.select("part", F.col("node").alias("leaf")), "leaf")
        .join(blocks.select(F.col("part").alias("block"), F.col("node").alias("other")), "other")
        .select("part", "block").join(first, ["part", "block"], "left_anti")
    )
    return Search(groups, blocks, first, found, floors.select("part", "floors"), materialize(left))


def top_k(vectors: DataFrame, queries: DataFrame | Column, config: TopKConfig | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score). `vectors` has (id, vector); `queries` is a condition on its rows, or
    another table of (id, vector)."""
    config = config or TopKConfig()
    rows = numbered(vectors.select("id", "vector"), queries, config.scale)
    plan = plan_search(rows, config)
    late = search_pairs(plan.left, plan.groups, plan.blocks, plan.floors, config)
    best = materialize(best_of(plan.found.unionByName(late), config.k + 1).select("qx", "qy", "x", "y", "score"))
    asked = rows.filter(F.col("kind").bitwiseAND(QUERY) != 0).select(F.col("id").alias("query_id"), F.col("row").alias("query_row"), F.col("a").alias("qx"), F.col("b").alias("qy"))
    row = F.when(F.col("y") < 0, -F.col("y") - 1).otherwise(F.col("y"))
    others = asked.join(best, ["qx", "qy"]).filter(row != F.col("query_row"))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "x", "y")
    return others.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.k).select(
        "query_id", "rank", F.when(F.col("y") >= 0, F.col("x")).alias("vec_id"), "score"
    )
