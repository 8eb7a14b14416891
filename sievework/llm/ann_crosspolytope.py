"""Approximate nearest neighbours by cross-polytope hashing (Andoni et al., 2015).

Each rotation turns the unit vectors by three rounds of random signs and a fast Hadamard transform and assigns
them to the nearest signed axis. A table concatenates ROTATIONS of them: a bucket is one axis of each, so there are (2 d) ** ROTATIONS buckets. A query
probes the buckets that are nearest by the summed nearness of their axes, in each table, and the candidates found there are
reranked by their exact cosine. Equal vectors are one candidate, with the few least ids that any answer can
hold. Buckets with neighbouring first axes lie in one group, so that a vector travels once for each table and a query at most GROUPS times. A
group is split into pieces of a bounded number of bytes, so none grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import ship_package, written

#: Tables, concatenated rotations of one, buckets that a query probes in one, rounds of a rotation. Defaults: set by the recall measured on near-random vectors.
TABLES, ROTATIONS, PROBES, ROUNDS = 16, 2, 320, 3
#: Axes of a rotation that a query's probes are made of; groups of a table's buckets.
AXES, GROUPS = 64, 16
#: Bytes of the vectors, as doubles, of one piece of a group; rows that are hashed at once.
PIECE_BYTES, BLOCK = 16 << 20, 256
#: Coarse scores within this of the last one kept are all reranked; pairs of one group that are held before the best are taken; vectors that are compared with all queries at once.
MARGIN, PAIRS, ALL_AT_ONCE = 1e-9, 1 << 20, 1 << 12


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


@lru_cache(maxsize=256)
def signs(table: int, rotation: int, width: int) -> np.ndarray:
    return np.random.default_rng((table, rotation, width)).choice([-1.0, 1.0], (ROUNDS, width))


def nearness(x: np.ndarray, table: int, rotation: int) -> np.ndarray:
    """How near each unit row is to each signed axis of a rotation: the axes, then their opposites."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for s in signs(table, rotation, width):
        y = hadamard(y * s)
    return np.concatenate([y, -y], axis=1)


def buckets(x: np.ndarray, table: int, rotations: int, probes: int) -> np.ndarray:
    """For each unit row its ``probes`` nearest buckets of the table, the first axis in the highest place; fewer if there are fewer."""
    codes, sums = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
    for r in range(rotations):
        near = nearness(x, table, r)
        axes = near.shape[1]
        few = min(axes, AXES, probes)
        best = near.argmax(axis=1)[:, None] if few == 1 else np.argsort(-near, axis=1, kind="stable")[:, :few]
        sums = (sums[:, :, None] + np.take_along_axis(near, best, 1)[:, None, :]).reshape(len(x), -1)
        codes = (codes[:, :, None] * axes + best[:, None, :]).reshape(len(x), -1)
        if sums.shape[1] > probes:
            top = np.argpartition(-sums, probes - 1, axis=1)[:, :probes]
            sums, codes = np.take_along_axis(sums, top, 1), np.take_along_axis(codes, top, 1)
    return codes


def groups_of(codes: np.ndarray, length: int, table: int, rotations: int) -> np.ndarray:
    """The group of each bucket; vectors of different length have none in common."""
    axes = 2 << max(0, length - 1).bit_length()
    return (codes // axes ** (rotations - 1)) * min(GROUPS, axes) // axes + (table << 44) + (length << 12)


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows with vectors of one length, and these as unit vectors."""
    for batch in batches:
        for _, rows in batch.groupby(batch["vec"].map(len)):
            for a in range(0, len(rows), BLOCK):
                some = rows.iloc[a : a + BLOCK]
                yield some, _unit(np.stack(list(some["vec"])).astype(float))


def _index(tables: int, rotations: int):
    """Adds for each table the bucket, and its group."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, x in _blocks(batches):
            codes = [buckets(x, t, rotations, 1)[:, 0] for t in range(tables)]
            slots = [groups_of(c, x.shape[1], t, rotations) for t, c in enumerate(codes)]
            yield rows.assign(slots=list(np.stack(slots, axis=1)), codes=list(np.stack(codes, axis=1)))

    return add


def _probe(tables: int, rotations: int, probes: int | None):
    """One row for each query and group that it looks at, with the buckets; None: all groups, and no list of buckets, which means all."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, x in _blocks(batches):
            at, slot, codes = [], [], []
            for t in range(tables):
                if probes is None:
                    axes = 2 << max(0, x.shape[1] - 1).bit_length()
                    all_ = np.unique(groups_of(np.arange(axes) * axes ** (rotations - 1), x.shape[1], t, rotations))
                    at.append(np.repeat(np.arange(len(rows)), len(all_)))
                    slot.append(np.tile(all_, len(rows)))
                    codes += [np.empty(0, dtype=np.int64)] * (len(rows) * len(all_))
                    continue
                found = np.sort(buckets(x, t, rotations, probes), axis=1)
                of = groups_of(found, x.shape[1], t, rotations)  # sorted too: the group follows from the first axis
                row, place = np.nonzero(np.c_[np.ones(len(of), dtype=bool), of[:, 1:] != of[:, :-1]])
                at.append(row)
                slot.append(of[row, place])
                stop = np.append(place[1:], 0)
                stop[np.append(row[1:] != row[:-1], True)] = of.shape[1]
                codes += [found[r, a:b] for r, a, b in zip(row.tolist(), place.tolist(), stop.tolist())]
            at = np.concatenate(at)
            yield pd.DataFrame({"vkey": rows["vkey"].to_numpy()[at], "vec": rows["vec"].to_numpy()[at], "slot": np.concatenate(slot), "codes": codes})

    return add


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component near one: no cosine changes, and none overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _meeting(codes: np.ndarray, wanted: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray]]:
    """Of the sorted ``codes`` each bucket that queries want, and these; a query that names none wants all."""
    every = np.array([n for n, w in enumerate(wanted) if not len(w)], dtype=np.int64)
    for a in range(0, len(codes), ALL_AT_ONCE) if len(every) else ():
        yield slice(a, a + ALL_AT_ONCE), every
    asked = np.concatenate([np.asarray(w, dtype=np.int64) for w in wanted])
    of = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
    own, starts, sizes = np.unique(codes, return_index=True, return_counts=True)
    there = np.isin(asked, own)
    order = np.argsort(asked[there], kind="stable")
    asked, of = asked[there][order], of[there][order]
    names, begin = np.unique(asked, return_index=True)
    at = np.searchsorted(own, names)
    for a, n, x, y in zip(starts[at].tolist(), sizes[at].tolist(), begin.tolist(), np.append(begin[1:], len(asked)).tolist()):
        yield slice(a, a + n), of[x:y]


def _best(of: np.ndarray, at: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query (sorted) the pairs within MARGIN of its ``top`` best scores."""
    order = np.lexsort((-score, of))
    of, at, score = of[order], at[order], score[order]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    sizes = np.diff(np.append(first, len(of)))
    last = score[first + np.minimum(sizes, top) - 1]
    kept = score >= np.repeat(last, sizes) - MARGIN
    return of[kept], at[kept], score[kept]


def _rerank(top: int):
    def rank(key, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        of, at, score = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        if len(vectors) and len(queries):
            vectors = vectors.iloc[np.argsort(vectors["code"].to_numpy(), kind="stable")]
            v, q = scaled(np.stack(list(vectors["vec"])).astype(float)), scaled(np.stack(list(queries["vec"])).astype(float))
            v_norms, q_norms = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            v_unit, q_unit = v / v_norms[:, None], q / q_norms[:, None]
            held, parts = 0, [(of, at, score)]
            for bucket, who in _meeting(vectors["code"].to_numpy(), list(queries["codes"])):
                # One product for a bucket and all queries that probe it.
                near = q_unit[who] @ v_unit[bucket].T
                n = near.shape[1]
                parts.append((np.repeat(who, n), np.tile(np.arange(bucket.start, bucket.start + n), len(who)), near.ravel()))
                held += near.size
                if held > PAIRS:
                    parts = [_best(*map(np.concatenate, zip(*parts)), top)]
                    held = 0
            of, at, _ = _best(*map(np.concatenate, zip(*parts)), top)
            # Products summed per pair: the same score in every bucket where the pair meets.
            score = (v[at] * q[of]).sum(axis=1) / (v_norms[at] * q_norms[of])
            order = np.lexsort((vectors["first_id"].to_numpy()[at], -score, of))
            of, at, score = of[order], at[order], score[order]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            of, at, score = of[place < top], at[place < top], score[place < top]
        return pd.DataFrame({"qkey": queries["vkey"].to_numpy()[of], "vkey": vectors["vkey"].to_numpy()[at], "first_id": vectors["first_id"].to_numpy()[at], "score": score})

    return rank


def _pieces(rows: DataFrame) -> DataFrame:
    """Pieces of each group, by the bytes of vectors and of lists of buckets."""
    held = F.size("vec") + (F.size("codes") if "codes" in rows.columns else F.lit(0))
    return rows.groupBy("slot").agg((1 + F.floor(F.sum(held) * 8 / PIECE_BYTES)).cast("long").alias("pieces"))


def _search(vectors: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(qkey, vkey, first_id, score): of each query's buckets the nearest ``top`` vectors, each pair once."""
    v = vectors.select("vkey", "vec", "first_id", F.explode(F.arrays_zip("slots", "codes")).alias("b")).select("vkey", "vec", "first_id", F.col("b.slots").alias("slot"), F.col("b.codes").alias("code"))
    split = _pieces(v).withColumnRenamed("pieces", "v_pieces").join(_pieces(queries).withColumnRenamed("pieces", "q_pieces"), "slot")
    split = written(split, "ann-pieces")
    v = v.join(split, "slot").withColumn("v_piece", F.pmod(F.xxhash64("vkey"), "v_pieces")).withColumn("q_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_pieces") - 1)))
    q = queries.join(split, "slot").withColumn("q_piece", F.pmod(F.xxhash64("vkey"), "q_pieces")).withColumn("v_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("v_pieces") - 1)))
    by = ("slot", "v_piece", "q_piece")
    found = v.select(*by, "vkey", "vec", "first_id", "code").groupBy(*by).cogroup(q.select(*by, "vkey", "vec", "codes").groupBy(*by)).applyInPandas(_rerank(top), "qkey string, vkey string, first_id long, score double")
    once = found.groupBy("qkey", "vkey").agg(F.min("first_id").alias("first_id"), F.max("score").alias("score"))
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "first_id", "vkey")
    return once.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top).drop("n")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, rotations: int = ROTATIONS, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows found nearest by cosine to each row where ``is_query`` (over the column ``id``).

    ``tables``, ``rotations`` and ``probes`` set the recall against the share of all vectors that a query looks at. The defaults are for vectors without structure, the
    worst case; where nearest neighbours are much nearer than other vectors (a cosine of 0.8, say), 16 probes do. Queries that found fewer than ``k`` others are searched again over all vectors
    of their length: exact, but its work is their number times that of the vectors, so ``probes`` should leave few of them.

    Ties go to the smaller id. Rows with a null id, or with a null, empty or zero vector or one that holds null or non-finite
    components, take no part; vectors of different length are never compared. Rows with equal ids are the query's own, and
    equal rows count once. Queries without other vectors of their length have no answer. An empty table gives an empty result. Components of any finite size are compared without overflow. Other columns are not read.
    """
    ship_package(vectors.sparkSession)
    # Floats travel as floats: every task turns them into doubles, which changes no value and moves half the bytes.
    vec = F.col(f"`{vec_col}`")
    if vectors.select(vec).schema[0].dataType.simpleString() != "array<float>":
        vec = vec.cast("array<double>")
    kind = vectors.select(vec).schema[0].dataType.simpleString()
    sound = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & sound)
    rows = rows.withColumn("vkey", F.concat_ws(":", F.xxhash64("vec"), F.xxhash64("vec", F.lit(1))))

    by_id = Window.partitionBy("vkey").orderBy("id")
    # Repeated rows go before the window; the window itself cuts each task's rows to the first few before they move.
    members = rows.select("vkey", "id").distinct().withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1).drop("n")
    members = written(members, "ann-members")
    distinct = rows.groupBy("vkey").agg(F.first("vec").alias("vec"), F.min("id").alias("first_id"))
    hashed = written(distinct.mapInPandas(_index(tables, rotations), f"vkey string, vec {kind}, first_id long, slots array<long>, codes array<long>"), "ann-index")
    asked = rows.where(is_query)
    queries = written(asked.groupBy("vkey").agg(F.first("vec").alias("vec")), "ann-queries")
    probed = f"vkey string, vec {kind}, slot long, codes array<long>"
    found = written(_search(hashed, queries.mapInPandas(_probe(tables, rotations, probes), probed), k + 1), "ann-found")

    enough = found.groupBy("qkey").agg(F.count("*").alias("n")).where(F.col("n") > k)
    short = written(queries.join(enough, F.col("vkey") == F.col("qkey"), "left_anti"), "ann-short")
    if not short.isEmpty():
        one_table = hashed.withColumns({c: F.slice(c, 1, 1) for c in ("slots", "codes")})
        again = _search(one_table, short.mapInPandas(_probe(1, rotations, None), probed), k + 1)
        found = found.join(short.select(F.col("vkey").alias("qkey")), "qkey", "left_anti").unionByName(again)

    # A query's own row may take one of the k + 1 places.
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "id")
    listed = found.select("qkey", "vkey", "score").join(members, "vkey").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("qkey", "id", "score")
    answers = asked.select(F.col("vkey").alias("qkey"), F.col("id").alias("query_id")).distinct().join(listed, "qkey").where("id <> query_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
