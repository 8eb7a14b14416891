"""The trie of conversation prefixes by truncation peeling.

Work begins at the greatest depth and goes up. The nodes of a depth are the conversations that end there, merged with the survivors of the depth below, whose last
turn has been stripped: equal prefixes meet in one group, which counts its conversations and children and adds up what its subtree brings. A node is found and finished in the same pass.

A prefix is named by a 128-bit hash of its parent's name and its last turn, so texts are hashed where they lie and never move. A conversation's names are kept in bands of BAND depths, so that a row
that is peeled carries at most that many. Below the first band most prefixes are rare: the conversations that share one there are peeled in one task down to the band, all depths at once, where
they have at most CROWDED turns below it. Where they have more, the next band is peeled depth by depth as well, with partial sums before each shuffle, and so on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import ship_package, text_of, written

#: Depths whose names a row carries; turns below a band that one task peels; ids whose list is one row.
BAND, CROWDED, ID_BITS = 8, 50_000, 12
NODE = "node binary, depth long, parent binary, conv long, n_convs long, n_children long, n_leaves long, saved long"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def digest_of(role: Column, text: Column) -> Column:
    """128 bits of a turn."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def turns_of(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn -> conv, at (1, 2, 3... in order of the turn, null first), digest, chars. Equal turn numbers go by the digest; null roles and texts are empty; rows without conversation are left out."""
    rows = rows.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"),
        F.col(f"`{turn_col}`").alias("turn"),
        digest_of(text_of(role_col), text_of(text_col)).alias("digest"),
        F.length(text_of(text_col)).cast("long").alias("chars"),
    )
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv", F.row_number().over(order).cast("long").alias("at"), "digest", "chars")


def _banded(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Rows in order of conv and at -> a row for each conversation and band: the name before the band, the names and characters of its depths."""
    conv, band, node, before, nodes, chars = None, 0, b"", b"", [], []
    for batch in batches:
        out = []
        for c, digest, n in zip(batch["conv"], batch["digest"], batch["chars"]):
            if c != conv:
                if conv is not None:
                    out.append((conv, band, before, nodes, chars, True))
                conv, band, node, before, nodes, chars = c, 0, b"", b"", [], []
            if digest is None:
                continue
            if len(nodes) == width:
                out.append((conv, band, before, nodes, chars, False))
                band, before, nodes, chars = band + 1, node, [], []
            node = hashlib.md5(node + digest).digest()
            nodes.append(node)
            chars.append(n)
        yield pd.DataFrame(out, columns=["conv", "band", "before", "nodes", "chars", "last"])
    if conv is not None:
        yield pd.DataFrame([(conv, band, before, nodes, chars, True)], columns=["conv", "band", "before", "nodes", "chars", "last"])


def peeled(group: pd.DataFrame, width: int = BAND) -> pd.DataFrame:
    """The nodes of conversations (rows by band) below the first row's band, that band's first node included."""
    group = group.sort_values(["conv", "band"], kind="stable")
    first = int(group["band"].min()) * width
    paths: dict[int, tuple[list[bytes], list[int]]] = {}
    for conv, before, nodes, chars in zip(group["conv"], group["before"], group["nodes"], group["chars"]):
        path = paths.setdefault(conv, ([before], [0]))
        path[0].extend(nodes)
        path[1].extend(chars)
    ending: dict[int, list[int]] = {}
    for conv, (nodes, _) in paths.items():
        ending.setdefault(len(nodes) - 1, []).append(conv)
    out, below = [], {}
    for depth in range(max(ending), 0, -1):
        now: dict[bytes, list[int]] = {}
        for conv in ending.get(depth, []):
            _merge(now, paths[conv][0][depth], conv, 1, 0, 0, 0)
        for conv, n_convs, _, n_leaves, saved in below.values():
            _merge(now, paths[conv][0][depth], conv, n_convs, 1, n_leaves, saved)
        for node, of in now.items():
            nodes, chars = paths[of[0]]
            of[3], of[4] = of[3] or 1, of[4] + (of[1] - 1) * int(chars[depth])
            out.append((node, first + depth, nodes[depth - 1], *of))
        below = now
    return pd.DataFrame(out, columns=["node", "depth", "parent", "conv", "n_convs", "n_children", "n_leaves", "saved"])


def _merge(into: dict[bytes, list[int]], node: bytes, conv: int, *counts: int) -> None:
    of = into.setdefault(node, [conv, 0, 0, 0, 0])
    of[0] = min(of[0], conv)
    for i, n in enumerate(counts, 1):
        of[i] += n


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    """Regroups what arrives at one depth."""
    found = rows.groupBy(*by).agg(F.min("conv").alias("conv"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")))
    return found.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long"))


def _arriving(found: DataFrame) -> DataFrame:
    """Nodes as children of the node that is left when their last turn goes."""
    return found.withColumn("n_children", F.lit(1).cast("long"))


def _one_conversation(n: int = 1) -> list[Column]:
    return [F.lit(n if c == "n_convs" else 0).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]


def _band_peeled(chunks: DataFrame, band: int, survivors: DataFrame | None, width: int) -> list[DataFrame]:
    """The nodes of a band, a table for each depth from the last to the first. chunks: of this band; survivors: the nodes at the depth below it."""
    state = ["before", "nodes", "chars", "conv", "n_convs", "n_children", "n_leaves", "saved"]
    ended = chunks.where("last").select("before", "nodes", "chars", "conv", *_one_conversation())
    above = None
    if survivors is not None:
        above = _arriving(survivors).join(chunks.select("conv", "before", "nodes", "chars"), "conv").select(*state)
    out = []
    for k in range(width, 0, -1):
        rows = ended.where(F.size("nodes") == k)
        rows = rows.unionByName(above) if above is not None else rows
        found = _sums(rows, "before", "nodes", "chars")
        found = written(found.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.element_at("chars", -1)), f"depth-{band * width + k}")
        parent = F.element_at("nodes", k - 1) if k > 1 else F.col("before")
        out.append(found.select(F.element_at("nodes", k).alias("node"), F.lit(band * width + k).cast("long").alias("depth"), parent.alias("parent"), *state[3:]))
        above = _arriving(found).withColumns({c: F.slice(c, 1, k - 1) for c in ("nodes", "chars")})
    return out


def _ends(chunks: DataFrame) -> DataFrame:
    """node, ends_sha256: of the ids that end there. The ids are joined in parts of bounded ranges; a node's parts are hashed in order as they stream by."""
    ended = chunks.where("last").select(F.when(F.size("nodes") > 0, F.element_at("nodes", -1)).otherwise(F.lit(b"")).alias("node"), "conv")
    parts = ended.groupBy("node", F.shiftright("conv", ID_BITS).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            out = []
            for at, ids in zip(batch["node"], batch["ids"]):
                if node is None or at != node:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])

    return parts.repartition("node").sortWithinPartitions("node", "part").select("node", "ids").mapInPandas(hashed, "node binary, ends_sha256 string")


def trie(turns: DataFrame, width: int = BAND, crowded: int = CROWDED) -> DataFrame:
    """Turns as of ``turns_of`` -> a row for each distinct prefix: node, depth, parent, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A row with a null digest names a conversation without giving it a turn: it belongs to the root, and ends there if it has no other row. Every conversation belongs to the textless root,
    depth 0, whose node is empty and whose parent is null. conv_id is the least member; saved_tokens adds up, over a node's subtree, the characters of the last turn for each conversation but one that
    shares it. Equal conversations end at one node, in any number, and are counted before they meet. Repeated places in one conversation go by their order of ``at``, then digest. An empty table gives no node, not
    even a root. Very long conversations are named as they stream by and cut into bands. Other columns are not read.
    """
    spark = turns.sparkSession
    ship_package(spark)
    ordered = turns.select("conv", "at", "digest", F.coalesce("chars", F.lit(0).cast("long")).alias("chars")).repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("at"), "digest").select("conv", "digest", "chars")
    kind = "conv long, band int, before binary, nodes array<binary>, chars array<long>, last boolean"
    chunks = written(ordered.mapInPandas(lambda batches: _banded(batches, width), kind), "bands")

    # Bands that are peeled depth by depth, each with the chunks that go through it; what lies below them is peeled in groups.
    here, bands, groups, band = chunks, [], {}, 0
    most = chunks.agg(F.max("band")).first()[0]
    while True:
        bands.append(here.where(F.col("band") == band))
        if most is None or band >= most:
            break
        heads = here.where(F.col("band") == band + 1).select("conv", F.element_at("nodes", 1).alias("head"))
        below = here.where(F.col("band") > band).join(heads, "conv")
        sizes = written(below.groupBy("head").agg(F.sum(F.size("nodes")).alias("n")).where(F.col("n") > crowded), "crowded-heads")
        groups[band] = written(below.join(sizes, "head", "left_anti").groupBy("head").applyInPandas(lambda group: peeled(group, width), NODE), "peeled")
        here = below.join(sizes, "head", "left_semi").drop("head")
        if sizes.isEmpty():
            break
        here, band = written(here, "crowded"), band + 1

    found, top = list(groups.values()), None
    for band in range(len(bands) - 1, -1, -1):
        first = F.col("depth") == (band + 1) * width + 1
        arrived = [x for x in ([groups[band].where(first)] if band in groups else []) + ([top] if top is not None else [])]
        survivors = None
        if arrived:
            survivors = arrived[0] if len(arrived) == 1 else arrived[0].unionByName(arrived[1])
            survivors = survivors.select("conv", "n_convs", "n_children", "n_leaves", "saved")
        depths = _band_peeled(bands[band], band, survivors, width)
        found, top = found + depths, depths[-1]

    turnless = chunks.where("last and size(nodes) = 0").select("conv", *_one_conversation())
    root = _sums(_arriving(top.select("conv", "n_convs", "n_children", "n_leaves", "saved")).unionByName(turnless)).where("conv is not null")
    root = root.select(F.lit(b"").alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "conv", "n_convs", "n_children", "n_leaves", "saved")
    nodes = root
    for level in found:
        nodes = nodes.unionByName(level)
    nodes = written(nodes, "nodes")

    # The root is the parent of a third of all nodes or more where many conversations are short: it needs no join.
    least = root_conv(nodes)
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    named = nodes.where("depth > 1").join(parents, "parent", "left").unionByName(nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least).cast("long"))))
    out = named.join(_ends(chunks), "node", "left")
    return out.select(
        "node", "depth", "parent", F.col("conv").alias("conv_id"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def root_conv(nodes: DataFrame) -> int | None:
    row = nodes.where("depth = 0").select("conv").first()
    return row[0] if row else None
