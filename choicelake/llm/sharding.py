"""Shards on a consistent-hash ring with virtual nodes and bounded loads.

Keys hash to cells of a ring; each shard owns the arcs before its virtual nodes.  A
shard takes its own keys up to its capacity, and keys that find it full go on clockwise
to the next shard with room.  The capacities add up to the rows exactly, so counts
differ by one at most (the law of ``rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from choicelake.llm.common import stored

CELLS = 1 << 16
VIRTUAL = 128
#: Rows of a cell beyond which it is ranked in lanes, if it also has eight times the mean.
HOT_CELL = 1 << 17
LANES = 512


def ring(spark: SparkSession, shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes clockwise; where two meet the lower shard stands."""
    nodes = (
        spark.range(shards * virtual)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("int").alias("copy"))
        .select(F.pmod(F.xxhash64("shard", "copy"), F.lit(CELLS)).cast("int").alias("cell"), "shard")
        .groupBy("cell").agg(F.min("shard").alias("shard"))
    )
    return sorted((r["cell"], r["shard"]) for r in nodes.collect())


def deal(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, rank_from, rank_to, shard, first_slot): where each cell's keys go.

    Own keys first, clockwise from cell 0; then what overflowed, clockwise from its own arc.
    """
    total = sum(counts.values())
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    load = [0] * shards
    cells, out, over = [c for c, _ in nodes], [], []
    from bisect import bisect_left

    for cell in sorted(counts):
        n, at = counts[cell], bisect_left(cells, cell) % len(nodes)
        shard = nodes[at][1]
        took = min(n, capacity[shard] - load[shard])
        if took:
            out.append((cell, 0, took, shard, load[shard]))
            load[shard] += took
        if took < n:
            over.append((cell, took, n, at))
    for cell, first, n, at in over:
        while first < n:
            shard = nodes[at % len(nodes)][1]
            took = min(n - first, capacity[shard] - load[shard])
            if took:
                out.append((cell, first, first + took, shard, load[shard]))
                load[shard] += took
                first += took
            at += 1
            if at > 3 * len(nodes) + len(cells):
                # shards without a virtual node of their own on the ring
                for shard in range(shards):
                    took = min(n - first, capacity[shard] - load[shard])
                    if took:
                        out.append((cell, first, first + took, shard, load[shard]))
                        load[shard] += took
                        first += took
    return out


def position(key: Column, text: Column) -> Column:
    """The key's place on the ring; rows without a key are placed by their text."""
    return F.xxhash64(key, F.when(key.isNull(), F.xxhash64(text)))


def assign(docs: DataFrame, shards: int = 8, virtual: int = VIRTUAL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row.

    To the driver come at most ``CELLS`` counts, and as much is broadcast back; texts never
    move and are read once.  Null texts have size 1 and the CRC of nothing.  Repeated rows are rows like
    others; ties within a place of the ring are broken by id, checksum and size.  A cell with far more
    rows than others (one id in a third of all rows) is ranked in ``LANES`` lanes, a task each.
    Other columns are not read.
    """
    spark = docs.sparkSession
    key, body = F.col(doc_id), F.coalesce(F.col(text), F.lit(""))
    place = position(key, F.col(text))
    cell = F.pmod(place, F.lit(CELLS)).cast("int")
    rows = stored(docs.select(
        key.alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        cell.alias("cell"), place.alias("place"), F.pmod(F.monotonically_increasing_id(), F.lit(LANES)).cast("int").alias("lane"),
    ))
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    dealt = deal(counts, ring(spark, shards, virtual), shards)
    schema = "p_cell int, rank_from long, rank_to long, shard int, first_slot long"
    plan = spark.createDataFrame(dealt, schema)
    least = max(HOT_CELL, 8 * sum(counts.values()) // CELLS)
    hot = sorted(c for c, n in counts.items() if n > least)  # an eighth of all cells at most
    order = Window.partitionBy("cell", "lane").orderBy("place", "doc_id", "text_crc32", "size")
    if hot:
        rows = rows.withColumn("lane", F.when(F.col("cell").isin(hot), F.col("lane")).otherwise(0))
        firsts = rows.where(F.col("cell").isin(hot)).groupBy("cell", "lane").agg(F.count("*").alias("n")).withColumn(
            "before", F.sum("n").over(Window.partitionBy("cell").orderBy("lane")) - F.col("n")
        ).drop("n")
        ranked = rows.withColumn("in_lane", F.row_number().over(order) - 1).join(firsts, ["cell", "lane"], "left")
        ranked = ranked.withColumn("rank", F.col("in_lane") + F.coalesce("before", F.lit(0)))
    else:
        ranked = rows.withColumn("lane", F.lit(0)).withColumn("rank", F.row_number().over(order) - 1)
    return ranked.join(
        F.broadcast(plan),
        (F.col("cell") == F.col("p_cell")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")),
    ).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - F.col("rank_from")).alias("slot")
    )


def write(docs: DataFrame, path: str, shards: int = 8, virtual: int = VIRTUAL, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write every row of ``docs`` to a folder per shard under ``path``, in the order of the slots.

    Rows meet their slots by id and checksum; rows alike in both share their slots in any order.
    """
    placed = assign(docs, shards, virtual, doc_id, text).withColumn(
        "_nth", F.row_number().over(Window.partitionBy("doc_id", "text_crc32").orderBy("shard", "slot"))
    ).select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "_nth", "shard", "slot")
    body = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    rows = docs.withColumn("_text_crc", body).withColumn(
        "_row", F.row_number().over(Window.partitionBy(doc_id, "_text_crc").orderBy(text))
    )
    (
        rows.join(placed, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_text_crc") == F.col("_crc")) & (F.col("_row") == F.col("_nth")))
        .drop("_id", "_crc", "_nth", "_text_crc", "_row")
        .repartition(shards, "shard").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )
