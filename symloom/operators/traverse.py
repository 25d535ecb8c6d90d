"""Bounded traversals of the call and include graphs, level by level, for whole sets of seeds.

Each level is one join; visited nodes leave by an anti join, and levels are cut from their lineage in the shared
checkpoint folder where there is one. A level of few nodes finds its edges by a scan and numbers those alone; from the
first level of many nodes on, the whole graph's edges are numbered once. Only counts of levels reach the driver.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_written: dict[str, SparkSession] = {}


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, written once as Parquet in spark.checkpoint.dir; where that is unset, kept in memory and on disk, which only local mode may.

    A checkpoint would run the last stage twice and take several times the room.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and context.getCheckpointDir():
        return df.checkpoint()
    if folder:
        path = f"{folder.rstrip('/')}/symloom-{uuid.uuid4().hex}"
        with _freeing(spark):
            df.write.option("compression", "zstd").parquet(path)
        _written[path] = spark
        return spark.read.schema(df.schema).parquet(path)
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return df.persist()


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is written; nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@atexit.register
def _delete_written() -> None:
    for path, spark in _written.items():
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone before us; the folder is then the cluster's to clean
            return


#: Up to so many nodes of a level are broadcast to the edges (about 100 bytes each).
FEW = 20_000


def _numbered(edges: DataFrame) -> DataFrame:
    """(src, dst, n): each edge once, numbered within its src by ord and dst."""
    order = Window.partitionBy("src").orderBy("ord", "dst")
    return edges.groupBy("src", "dst").agg(F.min("ord").alias("ord")).select("src", "dst", F.row_number().over(order).alias("n"))


def _steps(edges: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function of a level (node) that gives the numbered edges from its nodes on, or those of all nodes."""
    whole: DataFrame | None = None

    def step(level: DataFrame) -> DataFrame:
        nonlocal whole
        if whole is None:
            nodes = cut(level.select(F.col("node").alias("src")).distinct())
            if nodes.count() <= FEW:
                return cut(_numbered(edges.join(F.broadcast(nodes), "src", "left_semi")))
            whole = cut(_numbered(edges))
        return whole

    return step


def levels(edges: DataFrame, seeds: DataFrame, max_depth: int | None, fan_out: int | None = None, first: int | None = None) -> DataFrame:
    """(seed, node, depth): what each seed (seeds: seed) reaches over edges (src, dst, ord), the seed itself at 0.

    fan_out keeps each node's first edges by ord; first those of the seed itself. Without max_depth until nothing new
    is reached.
    """
    edges_of = _steps(edges)
    reached = frontier = cut(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct())
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        most = first if depth == 1 and first is not None else fan_out
        step = edges_of(frontier)
        step = step if most is None else step.where(F.col("n") <= most)
        new = frontier.join(step, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(new.join(reached, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = cut(reached.union(frontier))
    return reached


def _searched(edges: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """(seed, node, ranks, path): the best path to each node that a seed reaches; at max_depth only the nodes of pairs (seed, node).

    A seed is searched from until it has reached all its nodes.
    """
    edges_of = _steps(edges)
    frontier = cut(pairs.select("seed").distinct().select("seed", F.col("seed").alias("node"), F.array().cast("array<int>").alias("ranks"), F.array("seed").alias("path")))
    reached = frontier
    for depth in range(1, max_depth + 1):
        waiting = pairs.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").select("seed").distinct()
        frontier = cut(frontier.join(waiting, "seed", "left_semi"))
        step = edges_of(frontier)
        if depth == max_depth:  # the last level leads nowhere: of it only goals count
            step = step.join(pairs.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
        new = frontier.join(step, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), F.concat("ranks", F.array("n")).alias("ranks"), F.concat("path", F.array("dst")).alias("path"))
        best = new.groupBy("seed", "node").agg(F.min(F.struct("ranks", "path")).alias("b")).select("seed", "node", "b.ranks", "b.path")
        frontier = cut(best.join(reached.select("seed", "node"), ["seed", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = cut(reached.union(frontier))
    return reached


def _as_paths(found: DataFrame) -> DataFrame:
    return found.select("seed", F.col("node").alias("goal"), (F.size("path") - 1).alias("length"), F.array_join("path", ">").alias("path"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """(seed, goal, length, path) for each pair that is connected within max_depth.

    Of equally short paths that which first-in-first-out search finds: the least by the ranks of its edges, and ranks
    follow ord and dst.
    """
    wanted = cut(pairs.select("seed", F.col("goal").alias("node")).distinct())
    return _as_paths(_searched(edges, wanted, max_depth).join(pairs.select("seed", F.col("goal").alias("node")), ["seed", "node"]))


def paths_to_goals(edges: DataFrame, seeds: DataFrame, goals: DataFrame, max_depth: int) -> DataFrame:
    """shortest_paths of every seed (seeds: seed) with every goal (goals: goal), without making the pairs.

    Seeds are walked from in blocks, so what they reach is not written down.
    """
    return walked(walk_nodes(edges, seeds, goals), max_depth, _paths, "seed string, goal string, length int, path string")


#: Seeds of one task of a walk to goals; rows of a batch that it puts out; up to so many ids are broadcast (about 100 bytes each).
BLOCK, BATCH, SHIPPED = 25_000, 100_000, 200_000
#: From one seed for so many nodes on, every block gets all nodes.
DENSE = 8


def shipped(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """df of so many rows, broadcast if they are few."""
    return F.broadcast(df) if rows <= (SHIPPED if most is None else most) else df


def walk_nodes(edges: DataFrame, seeds: DataFrame, goals: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(node, name, seed, goal, mark, kids): all ids, numbered in their order, with the numbers of those their edges lead to, by ord and dst.

    edges: src, dst, ord; seeds: seed; goals: goal; marks: id.
    """
    edges = cut(edges.select("src", "dst", "ord").where("src is not null and dst is not null"))
    flagged = lambda df, c: df.select(F.col(c).alias("id"), *[F.lit(c == f).alias(f) for f in ("seed", "goal")]).distinct()
    ends = edges.select("src").union(edges.select("dst")).distinct().select(F.col("src").alias("id"), F.lit(False).alias("seed"), F.lit(False).alias("goal"))
    ids = flagged(seeds, "seed").union(flagged(goals, "goal")).union(ends).where("id is not null").groupBy("id").agg(F.max("seed").alias("seed"), F.max("goal").alias("goal"))
    marked = F.lit(False)
    if marks is not None:
        ids, marked = ids.join(marks.select("id", F.lit(True).alias("mark")).distinct(), "id", "left"), F.coalesce("mark", F.lit(False))
    ids = ranked_rows(ids.withColumn("mark", marked))
    many = ids.count()
    number = lambda c, k: shipped(ids.select(F.col("id").alias(c), F.col("k").alias(k)), many)
    ordered = F.array_sort(F.collect_list(F.struct("ord", "b")))
    lists = edges.join(number("src", "node"), "src").join(number("dst", "b"), "dst").groupBy("node").agg(F.array_distinct(F.transform(ordered, lambda e: e["b"])).alias("kids"))
    return cut(ids.select(F.col("k").alias("node"), F.col("id").alias("name"), "seed", "goal", "mark").join(lists, "node", "left"))


def walked(nodes: DataFrame, max_depth: int, emit: Callable, schema: str) -> DataFrame:
    """What emit makes of the shortest walks from each seed of walk_nodes, a block of seeds in each task.

    A block gets the edges of each node that any of its seeds passes once, and all goals.
    """
    n_seeds, n_nodes = nodes.agg(F.count(F.when(F.col("seed"), 1)), F.count(F.lit(1))).first()
    blocks = -(-n_seeds // BLOCK) or 1
    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    every = F.broadcast(nodes.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")))
    if n_seeds * DENSE >= n_nodes:
        rows = nodes.crossJoin(every)
    else:
        level = passed = nodes.where("seed").select(own.alias("block"), "node")
        for _ in range(max(1, max_depth - 1)):
            level = cut(level.join(nodes.select("node", "kids"), "node").select("block", F.explode("kids").alias("node")).distinct())
            passed = passed.union(level)
        rows = passed.union(nodes.where("goal").crossJoin(every).select("block", "node")).distinct().join(nodes, "node")
    rows = rows.select("block", "node", "name", (F.col("seed") & (own == F.col("block"))).alias("seed"), "goal", "mark", "kids")
    return rows.repartitionById(blocks, F.col("block")).mapInArrow(_walker(max_depth, emit), schema)


def _walker(max_depth: int, emit: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if found:
            table = pa.Table.from_batches(found)
            del found
            for block in pc.unique(table.column("block")):
                yield from emit(_Block(table.filter(pc.equal(table.column("block"), block)).sort_by("node").combine_chunks()), max_depth)

    return run


class _Block:
    """The nodes of a block by their places in it, and the edges from each to others of them, to goals alone also."""

    def __init__(self, table: pa.Table) -> None:
        flags = {c: table.column(c).to_numpy() for c in ("seed", "goal", "mark")}
        self.seeds, self.goal, self.mark = np.flatnonzero(flags["seed"]), flags["goal"], flags["mark"]
        self.names = table.column("name").combine_chunks()
        numbers, lists = table.column("node").to_numpy(), table.column("kids").combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        kids = lists.flatten().to_numpy(zero_copy_only=False)
        places = np.minimum(np.searchsorted(numbers, kids), len(numbers) - 1).astype(np.int32)
        here = numbers[places] == kids
        src = np.repeat(np.arange(len(numbers)), lengths)
        self.edges = self._rows(src[here], places[here])
        here &= self.goal[places]
        self.edges_to_goals = self._rows(src[here], places[here])

    def _rows(self, src: np.ndarray, kids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.bincount(src, minlength=len(self.goal))
        return np.cumsum(lengths) - lengths, lengths, kids

    def walks(self, max_depth: int) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
        """(seed, levels, parents): the nodes of each level as a first-in-first-out search comes to them, and where in the level before their parents are. At max_depth goals alone."""
        seen, place = np.full(len(self.goal), -1, np.int32), np.zeros(len(self.goal), np.int32)
        for s in self.seeds.tolist():
            levels, parents = [np.array([s], np.int32)], []
            seen[s] = s
            for depth in range(1, max_depth + 1):
                starts, lengths, kids = self.edges_to_goals if depth == max_depth else self.edges
                count_of = lengths[levels[-1]]
                ends = np.cumsum(count_of)
                reached = kids[np.repeat(starts[levels[-1]] - (ends - count_of), count_of) + np.arange(ends[-1])]
                new = np.flatnonzero(seen[reached] != s)
                if not len(new):
                    break
                reached = reached[new]
                turn = np.arange(len(new), dtype=np.int32)
                place[reached[::-1]] = turn[::-1]  # of equal nodes the first stays
                first = place[reached] == turn
                reached = reached[first]
                seen[reached] = s
                levels.append(reached)
                parents.append(np.searchsorted(ends, new[first], side="right"))
            yield s, levels, parents


def _paths(block: _Block, max_depth: int) -> Iterator[pa.RecordBatch]:
    """(seed, goal, length, path) for each goal that a seed reaches."""

    def batch(length: int, columns: list[list[np.ndarray]]) -> pa.RecordBatch:
        names = [block.names.take(pa.array(np.concatenate(c))) for c in columns]
        path = pc.binary_join_element_wise(*names, ">") if length else names[0]
        return pa.RecordBatch.from_arrays([names[0], names[-1], pa.array(np.full(len(path), length, np.int32)), path], names=["seed", "goal", "length", "path"])

    waiting = [([[] for _ in range(d + 1)], 0) for d in range(max_depth + 1)]
    for _, levels, parents in block.walks(max_depth):
        for d, level in enumerate(levels):
            at = np.flatnonzero(block.goal[level])
            if not len(at):
                continue
            columns, rows = waiting[d]
            rows += len(at)
            for k in range(d, -1, -1):
                columns[k].append(levels[k][at])
                if k:
                    at = parents[k - 1][at]
            if rows >= BATCH:
                yield batch(d, columns)
                columns, rows = [[] for _ in range(d + 1)], 0
            waiting[d] = columns, rows
    for d, (columns, rows) in enumerate(waiting):
        if rows:
            yield batch(d, columns)


def reach(block: _Block, max_depth: int) -> Iterator[pa.RecordBatch]:
    """(seed, near, reached, via): for each seed whether it or one of its kids is marked, and a bit for each goal, in their order, 64 a number:
    whether another path than the empty one leads there, and whether a node of that path is marked."""
    goals = np.flatnonzero(block.goal)
    number = np.zeros(len(block.goal), np.int64)
    number[goals] = np.arange(len(goals))
    starts, lengths, kids = block.edges
    near = block.mark.copy()
    near[np.repeat(np.arange(len(near)), lengths)[block.mark[kids]]] = True
    words = -(-len(goals) // 64)
    rows: list[tuple[int, np.ndarray, np.ndarray]] = []

    def batch() -> pa.RecordBatch:
        at = np.array([r[0] for r in rows])
        bits = [pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * words), pa.array(np.packbits(np.stack([r[k] for r in rows]), axis=1, bitorder="little").view("<i8").ravel())) for k in (1, 2)]
        return pa.RecordBatch.from_arrays([block.names.take(pa.array(at)), pa.array(near[at]), *bits], names=["seed", "near", "reached", "via"])

    for s, levels, parents in block.walks(max_depth):
        reached, through = np.zeros(words * 64, bool), np.zeros(words * 64, bool)
        via = block.mark[levels[0]]
        for level, parent in zip(levels[1:], parents, strict=True):
            via = via[parent] | block.mark[level]
            at = np.flatnonzero(block.goal[level])
            reached[number[level[at]]] = True
            through[number[level[at]]] = via[at]
        rows.append((s, reached, through))
        if len(rows) >= 1000:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


def call_tree(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, node_cap: int = 200) -> DataFrame:
    """(seed, position, depth, node, path): simple paths from each seed in preorder, the first node_cap - 1 of them.

    A level keeps the first node_cap - 1 rows of a seed: what comes after a dropped row in preorder comes after those.
    Before the next level, rows go whose predecessors and their children alone are as many.
    """
    edges_of = _steps(edges)
    level = seeds.select("seed").distinct().select("seed", F.col("seed").alias("node"), F.array().cast("array<int>").alias("ranks"), F.array("seed").alias("path"))
    all_levels = None
    by_seed = Window.partitionBy("seed").orderBy("ranks")
    # at least so many children: those that are on the path already are none
    weight = 1 + F.greatest(F.col("degree") - F.size("path"), F.lit(0))
    step = edges_of(level)
    for depth in range(1, max_depth + 1):
        level = level.join(step, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select("seed", F.col("dst").alias("node"), F.concat("ranks", F.array("n")).alias("ranks"), F.concat("path", F.array("dst")).alias("path"))
        if depth < max_depth:
            step = edges_of(step.select(F.col("dst").alias("node")))
            degrees = step.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
            level = level.join(degrees, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        level = level.withColumn("k", F.row_number().over(by_seed)).where(F.col("k") < node_cap)
        if depth < max_depth:
            level = level.withColumn("before", F.sum(weight).over(by_seed.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("before", F.lit(0)) < node_cap - 1).drop("before")
        level = cut(level.select("seed", "node", "ranks", "path"))
        all_levels = level if all_levels is None else all_levels.union(level)
        if level.isEmpty():
            break
    kept = all_levels.withColumn("position", F.row_number().over(by_seed)).where(F.col("position") < node_cap)
    return kept.select("seed", "position", F.size("ranks").alias("depth"), "node", F.array_join("path", ">").alias("path"))


def tree_shape(tree: DataFrame) -> DataFrame:
    """Per seed: edges and depth of its call tree."""
    return tree.groupBy("seed").agg(F.count(F.lit(1)).alias("n_edges"), F.max("depth").alias("depth"))


#: About so many seeds of an impact are walked from by one task.
WALKED = 20_000


def _ranked_ids(ids: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, k): numbers without gaps in the order of ids (id); of an id without symbol the number is negative, -1 the first."""
    known = symbols.select("id", F.lit(True).alias("known")).distinct()
    placed = ranked_rows(ids.distinct().join(known, "id", "left"))
    return placed.select("id", F.when(F.col("known"), F.col("k")).otherwise(-1 - F.col("k")).cast(dict(placed.dtypes)["k"]).alias("k"))


def ranked_rows(rows: DataFrame) -> DataFrame:
    """rows (id, ...) with k, their numbers without gaps in the order of id."""
    placed = cut(rows.orderBy("id").withColumn("k", F.monotonically_increasing_id()))
    task = F.shiftright("k", 33)
    starts, before = [], 0
    for r in placed.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect():
        starts += [F.lit(r["task"]), F.lit(before - (r["task"] << 33))]
        before += r["n"]
    if starts:
        placed = placed.withColumn("k", F.col("k") + F.create_map(*starts)[task])
    return placed.withColumn("k", F.col("k").cast("int" if before < 2**31 else "long"))


def _place(k: Column) -> Column:
    return F.when(k < 0, -1 - k).otherwise(k)


def _around(max_depth: int, top: int):
    """Of a block's table (block, kind, node, kids, counts, hub): each seed's most frequent symbols.

    Kinds 0 and 1 are the first edges of a node, down and up; kind 2 is a seed with the symbols that refer to it.
    """
    names = ["seed", "symbol", "n", "position", "total", "truncated"]

    def run(table: pa.Table) -> pa.Table:
        kind, at = table.column("kind").to_numpy(), table.column("node").to_numpy()
        lists = table.column("kids").combine_chunks()
        kids, starts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        counts, hub = table.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False), table.column("hub").to_numpy(zero_copy_only=False)
        nodes = np.unique(np.concatenate([at, kids]))
        here, kids = np.searchsorted(nodes, at), np.searchsorted(nodes, kids)
        # a list without counts has none: the lists of seeds alone have, in the order of the rows
        seeds = np.flatnonzero(kind == 2)
        counted_from = np.concatenate([[0], np.cumsum(starts[seeds + 1] - starts[seeds])])
        rows_of = []
        for k in (0, 1):
            row = np.full(len(nodes), -1)
            row[here[kind == k]] = np.flatnonzero(kind == k)
            rows_of.append(row)
        first_known, many = int(np.searchsorted(nodes, 0)), len(nodes)
        n, seen = np.zeros(many, np.int64), np.full(many, -1)
        out: list[list[np.ndarray]] = []
        for turn, s in enumerate(seeds.tolist()):
            touched, truncated = [], False
            for side, row in enumerate(rows_of):
                stamp = 2 * turn + side
                frontier = here[s : s + 1]
                seen[frontier] = stamp
                for _ in range(max_depth):
                    r = row[frontier]
                    r = r[r >= 0]
                    truncated = truncated or bool(hub[r].any())
                    lengths = starts[r + 1] - starts[r]
                    reached = kids[np.repeat(starts[r] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())] if len(r) else here[:0]
                    frontier = np.unique(reached[seen[reached] != stamp])
                    if not len(frontier):
                        break
                    seen[frontier] = stamp
                    n[frontier] += 1
                    touched.append(frontier)
            mentions = kids[starts[s] : starts[s + 1]]
            n[mentions] += counts[counted_from[turn] : counted_from[turn + 1]]
            all_touched = np.unique(np.concatenate([*touched, mentions])) if touched or len(mentions) else mentions
            found = all_touched[all_touched >= first_known]
            key = found - n[found] * many  # most frequent first, then in the order of ids
            if len(key) > top:
                key = np.partition(key, top - 1)[:top]
            best = np.sort(key) % many
            if len(best):
                out.append([np.full(len(best), at[s]), nodes[best], n[best], np.arange(1, len(best) + 1), np.full(len(best), len(found)), np.full(len(best), truncated)])
            n[all_touched] = 0
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * len(names)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
        return pa.table([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def impact(calls: DataFrame, references: DataFrame, symbols: DataFrame, seeds: DataFrame, max_depth: int = 2, limit: int = 50, top: int = 10, flags: bool = False) -> DataFrame:
    """(seed, symbol_id, n, position): how often each symbol turns up around a seed, the first `top`.

    Once for each direction of the call graph in which it is reached, and once for each direct reference. flags adds
    total, how many symbols turn up around the seed, and truncated: a node on the way has more than `limit` edges.

    Ids travel as numbers. Seeds are walked from in blocks: a block gets the edges of each node that any of its seeds
    passes once, and what is reached is counted there and never written down.
    """
    seeds = seeds.select("seed").distinct()
    # both are read several times
    edges = cut(calls.groupBy("caller_id", "callee_id").agg(F.min("line").alias("ord")))
    mentions = references.join(seeds.select(F.col("seed").alias("target_symbol_id")), "target_symbol_id", "left_semi").groupBy("target_symbol_id", "source_symbol_id").agg(F.count(F.lit(1)).alias("n"))
    mentions = cut(mentions)
    ids = _ranked_ids(seeds.select(F.col("seed").alias("id")).union(edges.select("caller_id")).union(edges.select("callee_id")).union(mentions.select("source_symbol_id")), symbols)
    number = lambda c, k: ids.select(F.col("id").alias(c), F.col("k").alias(k))
    edges = cut(edges.join(number("caller_id", "a"), "caller_id").join(number("callee_id", "b"), "callee_id").select("a", "b", "ord"))
    seeds = seeds.join(number("seed", "node"), "seed").select("node")
    seeds = cut(seeds.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(-(-seeds.count() // WALKED) or 1))))
    mentions = mentions.join(number("target_symbol_id", "node"), "target_symbol_id").join(number("source_symbol_id", "by"), "source_symbol_id")
    mentions = mentions.groupBy("node").agg(F.collect_list(F.struct("by", F.col("n").cast("int").alias("n"))).alias("m"))
    none, nobody = F.array().cast("array<int>"), F.array().cast(f"array<{dict(ids.dtypes)['k']}>")
    tables = seeds.join(mentions, "node", "left").select("block", F.lit(2).alias("kind"), "node", F.coalesce("m.by", nobody).alias("kids"), F.coalesce("m.n", none).alias("counts"), F.lit(False).alias("hub"))
    for kind, (src, dst) in enumerate((("a", "b"), ("b", "a"))):
        order = Window.partitionBy("node").orderBy("ord", _place(F.col("kid")))
        first = edges.select(F.col(src).alias("node"), F.col(dst).alias("kid"), "ord").withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit + 1)
        lists = cut(first.groupBy("node").agg(F.collect_list(F.when(F.col("n") <= limit, F.col("kid"))).alias("kids"), (F.max("n") > limit).alias("hub")))
        passed = seeds.select("block", "node")
        level = passed
        for _ in range(max_depth - 1):
            level = level.join(lists, "node").select("block", F.explode("kids").alias("node")).distinct()
            passed = passed.union(level)
        tables = tables.union(passed.distinct().join(lists, "node").select("block", F.lit(kind), "node", "kids", none, "hub"))
    counted = tables.groupBy("block").applyInArrow(_around(max_depth, top), "seed long, symbol long, n long, position int, total long, truncated boolean")
    named = counted.join(ids.select(F.col("k").alias("seed"), F.col("id").alias("seed_id")), "seed").join(ids.select(F.col("k").alias("symbol"), F.col("id").alias("symbol_id")), "symbol")
    return named.select(F.col("seed_id").alias("seed"), "symbol_id", "n", *(["total"] if flags else []), "position", *(["truncated"] if flags else []))


def include_closure(includes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(source, reached, depth): the files that each file includes, directly or not."""
    edges = includes.where("not is_system_include").select(F.col("source_file").alias("src"), F.col("included_file").alias("dst"), F.col("line").alias("ord"))
    seeds = edges.select(F.col("src").alias("seed")).distinct()
    return levels(edges, seeds, max_depth).where("depth > 0").select(F.col("seed").alias("source"), F.col("node").alias("reached"), "depth")


def include_cycles(includes: DataFrame, max_length: int | None = None) -> DataFrame:
    """(cycle, length): the simple include cycles of 2 files or more (at most max_length), each from its smallest file on.

    Only files on some cycle are walked: the others leave first, from both ends. A tangle of n files that all include
    each other has more than n! cycles.
    """
    edges = cut(includes.where("not is_system_include and source_file != included_file").select(F.col("source_file").alias("src"), F.col("included_file").alias("dst")).distinct())
    while True:
        core = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        core = cut(core.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if core.count() == edges.count():
            break
        edges = core
    paths = edges.where("src < dst").select(F.array("src", "dst").alias("path"))
    found = None
    for _ in count() if max_length is None else range(max_length - 1):
        stepped = paths.withColumn("src", F.element_at("path", -1)).join(edges, "src")
        closed = stepped.where(F.col("dst") == F.element_at("path", 1)).select(F.array_join("path", ">").alias("cycle"), F.size("path").alias("length"))
        found = cut(closed if found is None else found.union(closed))
        paths = cut(stepped.where((F.col("dst") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
        if paths.isEmpty():
            break
    return found.distinct()
