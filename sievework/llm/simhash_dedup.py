"""Near duplicates by SimHash fingerprints, with candidates pruned by the pigeonring principle.

The 64 bits form a ring of 8 segments of 8 bits. If two fingerprints differ in at most 3 bits, some segment
starts a chain in which the first l segments differ in at most l * 3 / 8 bits, for every l from 1 to 8 (Qin
and Xiao, "Pigeonring", 2018). Rounded down, the budgets are 0, 0, 1, 1, 1, 2, 2, 3: the first two segments
are equal and at most one bit differs in the next three, so at least two of these are equal too. Hence three
keys of 32 bits for each start meet every linked pair. Fingerprints that meet under a key are put to the
whole chain, whose last step is the full Hamming check.

Equal fingerprints are one node from the start, so copies cost nothing. A key's nodes yield a star for each
of their connected classes, never all their pairs; large and small stars (Kiveris et al., 2014) then join the
stars across keys, each round written to the shared folder. Where many nodes meet under a key, its 32 free
bits are split the same way: of their 4 bytes one is equal, and of the other 24 bits one of 4 groups of 6. So at
most 2^18 nodes, of 4 bytes each, ever come together, however large a group of near copies is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import ship_package, text_of, written
from sievework.llm.mph import STEP, _mixed

SEED, SEGMENTS, MAX_BITS = 42, 8, 3
#: Nodes under one key from which a node's neighbours are looked up instead of compared one by one.
MANY = 20_000
#: Nodes under one key from which its free bits are split.
SPLIT = 1 << 16
#: Shingles whose bits are counted at once; a fingerprint is heavy from this fraction of the rows.
BLOCK, HEAVY = 65_536, 1_000


def fingerprint(text: str, width: int = 3) -> int:
    """The SimHash of the text's word shingles, repeats included; no words: 0."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return 0
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts + lengths
    if len(words) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    h = xxhash.xxh64_intdigest
    blocks = range(0, len(starts), BLOCK)
    return majority((np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts[a : a + BLOCK].tolist(), ends[a : a + BLOCK].tolist())), dtype="<u8") for a in blocks), len(starts))


def majority(blocks: Iterable[np.ndarray], n: int) -> int:
    """The bits that are set in over half of the ``n`` hashes, which come in blocks."""
    counts = np.zeros(64, dtype=np.int64)
    for hashes in blocks:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, keep: list[str], text_col: str = "text", width: int = 3) -> DataFrame:
    """The columns ``keep`` of ``docs`` and fp, the fingerprint as a signed long."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(*(F.col(f"`{c}`") for c in keep), fp(text_of(text_col)).alias("fp"))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x if bits % 64 == 0 else (x << np.uint64(bits % 64)) | (x >> np.uint64(64 - bits % 64))


def chain_holds(differences: np.ndarray, bits: int = MAX_BITS) -> np.ndarray:
    """Indexes of the differences (turned so that the chain starts at the top) that stay within every budget."""
    at = np.arange(len(differences))
    for n in range(1, SEGMENTS + 1):
        at = at[np.bitwise_count(differences[at] >> np.uint64(64 - 64 // SEGMENTS * n)) <= n * bits // SEGMENTS]
    return at


def within(differences: np.ndarray, bits: int) -> np.ndarray:
    """Which differences have a chain within the budgets for ``bits`` from some start: those of at most so many bits."""
    found = np.zeros(len(differences), dtype=bool)
    left = np.arange(len(differences))
    for start in range(SEGMENTS):
        found[left[chain_holds(_turned(differences[left], 64 // SEGMENTS * start), bits)]] = True
        left = np.flatnonzero(~found)
    return found


@lru_cache(maxsize=1)
def viable_differences() -> np.ndarray:
    """Every nonzero difference whose chain from the top holds."""
    one = [1 << b for b in range(64)]
    masks = np.array([sum(x) for n in range(1, MAX_BITS + 1) for x in combinations(one[:48], n)], dtype=np.uint64)
    return masks[chain_holds(masks)]


def classes(nodes: np.ndarray) -> list[np.ndarray]:
    """The connected classes, of two nodes or more, of nodes turned so that their chain starts at the top.

    Each node met is compared with those not yet met; from MANY nodes on, its possible neighbours (their
    number is fixed) are looked up instead, so time grows in proportion to the nodes.
    """
    left, found = np.sort(nodes), []
    alive = np.ones(len(left), dtype=bool)
    first = 0
    while len(left) - first > 1:
        if len(left) <= MANY and first:
            left, alive, first = left[alive], alive[alive], 0
            if len(left) < 2:
                break
        while first < len(left) and not alive[first]:
            first += 1
        if first == len(left):
            break
        alive[first] = False
        met, todo = [left[first]], [left[first]]
        first += 1
        while todo:
            node = todo.pop()
            if len(left) > MANY:
                wanted = viable_differences() ^ node
                at = np.searchsorted(left, wanted)
                at = at[(at < len(left)) & (left[np.minimum(at, len(left) - 1)] == wanted)]
            else:
                at = np.flatnonzero(alive)
                at = at[chain_holds(left[at] ^ node)]
            at = at[alive[at]]
            alive[at] = False
            met.extend(left[at])
            todo.extend(left[at])
        if len(met) > 1:
            found.append(np.array(met, dtype=np.uint64))
    return found


#: Of the segments after the first two, which two a key holds and which one is left free.
VARIANTS = ((2, 3, 4), (2, 4, 3), (3, 4, 2))


def unpacked(key: int, free: np.ndarray) -> np.ndarray:
    """The turned fingerprints of a key's nodes, from their free bits."""
    x, y, z = VARIANTS[(key >> 32) % 3]
    held = (key & 0xFFFF0000) << 32 | (key >> 8 & 255) << (56 - 8 * x) | (key & 255) << (56 - 8 * y)
    free = free.astype(np.uint32).astype(np.uint64)
    return np.uint64(held) | (free >> np.uint64(24)) << np.uint64(56 - 8 * z) | (free & np.uint64(0xFFFFFF))


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ends, centres = [], []
        for key, free in zip(batch["key"], batch["nodes"]):
            turn = turn_of(int(key))
            for c in classes(unpacked(int(key), np.asarray(free))):
                c = np.sort(_turned(c, 64 - turn).view(np.int64))
                ends.append(c[1:])
                centres.append(np.full(len(c) - 1, c[0]))
        if ends:
            yield pd.DataFrame({"a": np.concatenate(ends), "b": np.concatenate(centres)})


def keys_and_free(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start and variant (rows) and fingerprint (columns) the key and the 32 bits that it leaves free. A key also tells start and variant."""
    keys, free = [], []
    for i in range(SEGMENTS):
        turned = _turned(fps, 64 // SEGMENTS * i)
        segment = [turned >> np.uint64(56 - 8 * n) & np.uint64(255) for n in range(5)]
        for v, (x, y, z) in enumerate(VARIANTS):
            start = np.uint64((3 * i + v) << 32)
            keys.append((start | turned >> np.uint64(48) << np.uint64(16) | segment[x] << np.uint64(8) | segment[y]).view(np.int64))
            free.append((segment[z] << np.uint64(24) | turned & np.uint64(0xFFFFFF)).astype(np.uint32).view(np.int32))
    return np.stack(keys), np.stack(free)


def turn_of(key: int) -> int:
    """The bits to turn a key's fingerprints so that the chain starts at the top."""
    return 64 // SEGMENTS * ((key >> 32) // 3)


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        key, free = keys_and_free(batch["fp"].to_numpy().view(np.uint64))
        yield pd.DataFrame({"key": key.ravel(), "free": free.ravel()})


def links(nodes: DataFrame) -> DataFrame:
    """``nodes`` (fp, distinct) -> links a > b between fingerprints, enough of them to keep every class of linked ones together.

    A node under a key is the key (with the start and variant it is for) and the 32 bits that the key leaves free.
    """
    ship_package(nodes.sparkSession)
    keyed = nodes.select("fp").mapInPandas(_keyed, "key long, free int")
    met = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "met-keys")
    parts = []
    for j in range(4):
        byte, low = f"(shiftrightunsigned(free, {24 - 8 * j}) & 255)", 24 - 8 * j
        above = f"shiftrightunsigned(free, {low + 8}) << {low} | " if j else ""
        rest = f"({above}(free & {(1 << low) - 1}))"
        parts += [f"{4 * j + m} << 14 | {byte} << 6 | (shiftrightunsigned({rest}, {18 - 6 * m}) & 63)" for m in range(4)]
    part = F.when(F.col("n") <= SPLIT, F.array(F.lit(-1))).otherwise(F.array(*(F.expr(p) for p in parts)))
    together = keyed.join(met, "key").withColumn("part", F.explode(part)).groupBy("key", "part").agg(F.collect_list("free").alias("nodes"))
    return together.where(F.size("nodes") > 1).select("key", "nodes").mapInPandas(_stars, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Links a > b -> one row (a, b) for each node but the least of its component, b being that least node."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = written(edges, "links")
    before, now = None, state(edges)
    while now != before and now[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.distinct(), "stars")
        before, now = now, state(edges)
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hexadecimal digits), component_id.

    Fingerprints that differ in at most 3 bits link; component_id is the least id that links lead to, the row's
    own included. Null and blank texts have fingerprint zero, which links like any other. Null ids name no component: where all
    rows of one have none, component_id is null. Repeated rows stay. An empty table gives an empty result. Texts of any length count whole, their shingles
    a bounded number at a time. Other columns are not read.
    """
    slim = written(with_fingerprint(docs, [id_col], text_col, width), "fingerprints")
    nodes = written(slim.groupBy("fp").agg(F.min(f"`{id_col}`").alias("first_id"), F.count("*").alias("n")), "nodes")
    stars = components(links(nodes.select("fp")))
    labelled = nodes.join(stars.select(F.col("a").alias("fp"), F.col("b").alias("centre")), "fp", "left").select("fp", "first_id", F.coalesce("centre", "fp").alias("centre"))
    least = labelled.groupBy("centre").agg(F.min("first_id").alias("component_id"))
    named = written(labelled.join(least, "centre").select("fp", "component_id"), "components")
    # Fingerprints that many rows have, HEAVY of them at most, are sent to the rows; only rows of the others move.
    many = nodes.where(F.col("n") * HEAVY > (nodes.agg(F.sum("n")).first()[0] or 0)).select("fp")
    heavy = written(named.join(F.broadcast(many), "fp", "left_semi"), "heavy-fingerprints")
    rest = slim.join(F.broadcast(heavy.select("fp")), "fp", "left_anti").join(named, "fp")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return slim.join(F.broadcast(heavy), "fp").unionByName(rest).select(f"`{id_col}`", hexed.alias("fingerprint"), "component_id")
