"""Sharding by a consistent-hash ring with virtual nodes and bounded loads; DataFrame functions only.

Shards have virtual nodes on a ring of 2^16 cells; a row belongs to the first node clockwise of the hash of its id and text,
so that rows without an id, or of one id, are dealt like any others. A shard that is full takes no more: what overflows goes on clockwise to the next node whose shard has room. With the
exact capacities of the law `rows` (their sum is the number of rows) the counts end at most one apart; with a load
factor c > 1 a shard holds at most ceil(c * rows / shards), and fewer rows move when a shard is added.

Rows are counted by cell, and cells by arc (between two nodes), so the plan of who overflows where is made on at most
`shards * nodes` counts, whatever the corpus. A row finds its shard by its rank within its arc, counted by cells.

Defined results: a null text has size 16 and the checksum of no bytes; a null id is an id like any other. Rows alike
(same id and text) are counted once with their number and dealt out again. Ties of the hash are ordered by id, size
and checksum. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.base import cut, table, unrolled

CELL_BITS = 16


def ring(spark: SparkSession, shards: int, nodes: int, seed: int) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in ring order; where two fall into one cell, the smaller shard has it."""
    # a node's place depends on its shard and its number alone, so a shard more leaves all others where they are
    named = spark.range(shards * nodes).select(F.floor(F.col("id") / nodes).cast("int").alias("shard"), (F.col("id") % nodes).alias("node"))
    spots = named.select("shard", F.shiftrightunsigned(F.xxhash64("shard", "node", F.lit(seed)), 64 - CELL_BITS).alias("cell"))
    return [(r.cell, r.shard) for r in spots.groupBy("cell").agg(F.min("shard").alias("shard")).orderBy("cell").collect()]


def overflow_plan(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): which ranks of each arc's rows go to which shard.

    Arcs are served in ring order, their overflow after them in the order in which it arose.
    """
    n, used = len(counts), [0] * len(room)
    onward = list(range(1, n)) + [0]
    out = []
    queue = deque((a, a, 0) for a in range(n) if counts[a])
    while queue:
        at, arc, first = queue.popleft()
        hops = 0
        while used[owners[at]] >= room[owners[at]]:
            at, hops = onward[at], hops + 1
            if hops > n:
                raise ValueError("the shards' capacities are below the number of rows")
        shard = owners[at]
        k = min(counts[arc] - first, room[shard] - used[shard])
        out.append((arc, first, first + k, shard, used[shard]))
        used[shard] += k
        if first + k < counts[arc]:
            queue.append((onward[at], arc, first + k))
    return out


def assign(docs: DataFrame, shards: int = 40, nodes: int = 128, load: float | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of `docs` (doc_id, text); load None: the law `rows`."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    groups = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    groups = cut(groups.withColumn("pos", F.xxhash64("doc_id", "size", "text_crc32", F.lit(seed))).withColumn("cell", F.shiftrightunsigned("pos", 64 - CELL_BITS)))

    spots = ring(spark, shards, nodes, seed)
    # the arc of a cell: the first node at or after it, else the first of all; at most 2^16 rows
    nodes_at = spark.createDataFrame([(c, a) for a, (c, _) in enumerate(spots)], "node_cell long, arc int")
    cells = spark.range(1 << CELL_BITS).withColumnRenamed("id", "cell").join(F.broadcast(nodes_at), F.col("cell") == F.col("node_cell"), "left")
    # from the last cell backwards, so that the window's running value is kept and not sought anew for each cell
    onward = Window.partitionBy(F.lit(0)).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("cell", F.coalesce(F.last("arc", ignorenulls=True).over(onward), F.lit(0)).alias("arc"))
    held = groups.groupBy("cell").agg(F.sum("n").alias("held")).join(cells, "cell")
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    held = cut(held.withColumn("cell_first", F.coalesce(F.sum("held").over(before), F.lit(0))).select("cell", "arc", "held", "cell_first"))

    counts = [0] * len(spots)
    for r in held.groupBy("arc").agg(F.sum("held").alias("n")).collect():  # a row for each arc
        counts[r.arc] = r.n
    total = sum(counts)
    room = [-(-total // shards) if s < total % shards else total // shards for s in range(shards)] if load is None else [-int(-load * total // shards)] * shards
    plan = overflow_plan(counts, [s for _, s in spots], room)
    plan_rows = spark.createDataFrame(plan, "plan_arc int, first_rank long, end_rank long, shard int, first_slot long")

    w = Window.partitionBy("cell").orderBy("pos", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("__in_cell", F.coalesce(F.sum("n").over(w), F.lit(0))).join(F.broadcast(held.select("cell", "arc", "cell_first")), "cell")
    placed = unrolled(placed, "n", "i", "pos")
    placed = placed.withColumn("rank", F.col("cell_first") + F.col("__in_cell") + F.col("i"))
    # at most a row for each arc and one more for each shard that fills up
    met = placed.join(F.broadcast(plan_rows), (F.col("arc") == F.col("plan_arc")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    return met.select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - F.col("first_rank")).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = assign(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
