"""Sharding by Karmarkar-Karp differencing, under the law ``bytes``: shard sizes near equal.

Rows with equal texts form an indivisible group. A group that holds its share of a cell or more is a cell of its own; a
hash of the text deals the others, whole, into ``CELLS`` cells. The cells' byte sums (a bounded number of them) go to the driver, where
multiway differencing starts from one partial partition per cell and again and again combines the two with
the largest spread, the largest part of one with the smallest of the other. Texts are never shuffled to
find their groups: equal texts have equal hashes.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import text_of, written

#: The number of cells of small groups, and the most groups that are cells of their own: bounds what the driver holds and what is broadcast.
CELLS = 16_384
#: Rows that one task numbers; a cell with more is numbered in several pieces.
PIECE_ROWS = 1_000


def differencing(sizes: dict[int, int], parts: int) -> dict[int, int]:
    """The part of each key. Largest spread first; ties by key, so that reruns agree."""
    if not sizes:
        return {}
    heap = [(-size, key, [(0, ())] * (parts - 1) + [(size, (key,))]) for key, size in sizes.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, key, one), (_, _, other) = heapq.heappop(heap), heapq.heappop(heap)
        # A part's keys stay a tree of pairs until the end: joining two is one step, whatever they hold.
        both = sorted(((a + b, (x, y)) for (a, x), (b, y) in zip(one, reversed(other))), key=lambda p: p[0])
        low = both[0][0]
        heapq.heappush(heap, (low - both[-1][0], key, [(size, held) for size, held in both] if low == 0 else [(size - low, held) for size, held in both]))
    found = {}
    for part, (_, held) in enumerate(heap[0][2]):
        todo = [held]
        while todo:
            for x in todo.pop():
                todo.append(x) if isinstance(x, tuple) else found.__setitem__(x, part)
    return found


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``, all unless given) with size, text_crc32, law, shard, slot and grown_shard.

    size is the text's UTF-8 bytes plus 1. Null text counts as empty text. Every row gets a place, repeated
    rows too, each its own slot; slots of a shard count from 0 without gaps, in an order that depends only on
    the rows (among rows that agree in id and text, on where they were read). Such rows are numbered in pieces, however many there are. grown_shard is null under this law. Columns of the input that have one of these names are
    replaced, whatever their case. An empty table gives an empty result. A text's length matters to its size alone.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(kept)),
        F.col(f"`{id_col}`").cast("string").alias("id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    total, most = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    # Not more than CELLS groups can be as large as that.
    large = sorted(r.group for r in groups.where(F.col("bytes") * CELLS >= total).select("group").collect())
    heavy = F.broadcast(spark.createDataFrame([(g, CELLS + i) for i, g in enumerate(large)], "group long, own int"))
    cell = F.coalesce("own", F.pmod("group", F.lit(CELLS))).cast("int").alias("cell")
    cells = groups.join(heavy, "group", "left").groupBy(cell).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
    part = differencing({r.cell: r.bytes for r in cells}, shards)
    places = spark.createDataFrame([(r.cell, part[r.cell], 1 + r.n // PIECE_ROWS) for r in cells], "cell int, shard int, pieces long")
    # An id decides the piece, the text's hash where there is no id.
    lot = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), "group"), "pieces")
    placed = rows.join(heavy, "group", "left").withColumn("cell", cell).drop("own").join(F.broadcast(places), "cell").withColumn("piece", lot).withColumn("at", F.lit(0).cast("long"))

    # Rows that agree in id and text have one lot: where they are many, their places in the table deal them out.
    many_of = groups.where(F.col("n") > PIECE_ROWS).select("group")
    alike = placed.join(many_of, "group", "left_semi").groupBy("id", "group").agg(F.count("*").alias("rows")).where(F.col("rows") > PIECE_ROWS)
    alike = alike.select(F.col("id").alias("many_id"), F.col("group").alias("many_group"), F.lit(True).alias("many"))
    if most > PIECE_ROWS and not (alike := written(alike, "shard-alike")).isEmpty():
        placed = placed.join(alike, F.col("id").eqNullSafe(F.col("many_id")) & (F.col("group") == F.col("many_group")), "left").drop("many_id", "many_group")
        many = written(placed.where("many").withColumn("at", F.monotonically_increasing_id()), "shard-many")
        many = many.withColumn("piece", F.lit(1 << 32) + F.expr(f"at div {PIECE_ROWS}"))
        placed = placed.where("many is null").unionByName(many)

    by_shard = Window.partitionBy("shard").orderBy("cell", "piece").rowsBetween(Window.unboundedPreceding, -1)
    before = written(placed.groupBy("shard", "cell", "piece").agg(F.count("*").alias("n")), "shard-pieces")
    before = before.select("cell", "piece", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("before"))
    in_piece = Window.partitionBy("cell", "piece").orderBy("id", "group", "at")
    numbered = placed.withColumn("at", F.row_number().over(in_piece))
    return numbered.join(before, ["cell", "piece"]).select(
        *(F.col(f"in_{i}").alias(c) for i, c in enumerate(kept)),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("at") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
