"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of features x is w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, through a sigmoid. The pair
sum is taken in linear time as half of sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2). The model has a fixed
size. It is fitted on about MAX_ROWS labelled texts and MAX_BYTES of features at most, drawn by a hash of id and text; everything else runs over
every whole text where it lies.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import ship_package, text_of, written

#: Labelled texts that the model is fitted on, and bytes of their features, at most (in expectation).
MAX_ROWS, MAX_BYTES = 20_000, 200_000_000
#: Buckets of hashed words, buckets of hashed metadata, length of a factor, passes, rows of a step, step size, shrinkage.
WORD_BUCKETS, META_BUCKETS, RANK, EPOCHS, BATCH, RATE, SHRINK = 1 << 15, 256, 8, 6, 128, 0.05, 1e-4
#: Classes of ASCII marks whose share of a text's bytes is a statistic.
MARKS = ["!", "|", "$%&*#", ".", ",", "?:;", "<>{}[]()=/\\_", "\"'`-", "@+~^"]
#: Features scored at once.
BLOCK = 400_000


def _byte_classes() -> np.ndarray:
    """Class of each byte: 0 other, 1 A-Z, 2 a-z, 3 0-9, 4 blank, 5 newline, 6 not ASCII, then MARKS."""
    c = np.zeros(256, dtype=np.int64)
    c[65:91], c[97:123], c[48:58], c[128:] = 1, 2, 3, 6
    c[[9, 11, 12, 13, 32]], c[10] = 4, 5
    for i, marks in enumerate(MARKS):
        c[[ord(m) for m in marks]] = 7 + i
    return c


CLASSES = _byte_classes()
SHARES = 7 + len(MARKS)
STATS = SHARES + 8
WIDTH = WORD_BUCKETS + META_BUCKETS + STATS
#: How features travel to the driver.
INDEX, VALUE = np.dtype("<u2"), np.dtype("<f4")


def features(texts, metas) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, start of each row) of the sparse rows. A row: its statistics, metadata, then words with unit length, those of one bucket added up."""
    index, value, starts, at = [], [], [], 0
    for text, meta in zip(texts, metas):
        data = text.encode()
        words = data.lower().split()
        counts = Counter(words)
        lines = [x for x in data.split(b"\n") if x]
        n, distinct = max(1, len(words)), len(counts)
        share = np.bincount(CLASSES[np.frombuffer(data, dtype=np.uint8)], minlength=SHARES) / max(1, len(data))
        more = (np.log1p(len(words)), np.log1p(len(data)), sum(map(len, words)) / n / 10, distinct / n, max(counts.values(), default=0) / n, len(set(lines)) / max(1, len(lines)), len(lines) / n, sum(map(eq, words, words[1:])) / n)
        tags = [WORD_BUCKETS + crc32(m.encode()) % META_BUCKETS for m in meta.split("\x1f") if m]
        hashed, of = np.unique(np.fromiter(map(crc32, counts), dtype=np.int64, count=distinct) % WORD_BUCKETS, return_inverse=True)
        tf = 1 + np.log(np.bincount(of, weights=np.fromiter(counts.values(), dtype=np.float64, count=distinct), minlength=len(hashed)))
        tags, times = np.unique(np.array(tags, dtype=np.int64), return_counts=True)
        index += [np.arange(WIDTH - STATS, WIDTH), tags, hashed]
        value += [share, more, times, tf / (np.sqrt((tf * tf).sum()) or 1)]
        starts.append(at)
        at += STATS + len(tags) + len(hashed)
    if not starts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.float32), np.empty(0, dtype=np.int64)
    return np.concatenate(index), np.concatenate(value).astype(np.float32), np.array(starts)


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scaled(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The values with statistics centred and scaled, within -4 and 4."""
        at = starts[:, None] + np.arange(STATS)
        value = value.copy()
        value[at] = np.clip((value[at] - self.mean) / self.scale, -4, 4)
        return value

    def scores(self, texts, metas) -> np.ndarray:
        out = []
        for a, b in blocks_of(texts):
            index, value, starts = features(texts[a:b], metas[a:b])
            out.append(self.sigmoid(self.raw(index, self.scaled(index, value, starts), starts)[0]))
        return np.concatenate(out).astype(float) if out else np.empty(0)

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores before the sigmoid, and the factor sums of each row."""
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx * vx, starts, axis=0)).sum(axis=1)
        return self.w0 + np.add.reduceat(self.w[index] * value, starts) + pairs, sums

    @staticmethod
    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x.astype(float), -30, 30)))


def blocks_of(texts) -> Iterator[tuple[int, int]]:
    """Runs of rows with about BLOCK features or fewer; a word takes two bytes at least."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) // 2 + STATS
        if size >= BLOCK:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def fit(index: np.ndarray, value: np.ndarray, starts: np.ndarray, labels: np.ndarray, seed: int = 1) -> Model:
    """Logistic loss, AdaGrad steps. With one class or none only the base rate is learned (0.5 without rows)."""
    rng, n = np.random.default_rng(seed), len(labels)
    rate = (labels.sum() + 1) / (n + 2)
    model = Model(float(np.log(rate / (1 - rate))), np.zeros(WIDTH, np.float32), np.zeros((WIDTH, RANK), np.float32), np.zeros(STATS, np.float32), np.ones(STATS, np.float32))
    if n == 0 or labels.min() == labels.max():
        return model
    stats = value[starts[:, None] + np.arange(STATS)]
    model.mean, model.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    value = model.scaled(index, value, starts)
    model.v = rng.normal(0, 0.02, (WIDTH, RANK)).astype(np.float32)
    g0, gw, gv = 1.0, np.full(WIDTH, 1e-2, np.float32), np.full((WIDTH, RANK), 1e-2, np.float32)
    ends = np.append(starts[1:], len(index))
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            rows = order[a : a + BATCH]
            sizes = ends[rows] - starts[rows]
            first = np.cumsum(sizes) - sizes
            at = np.repeat(starts[rows] - first, sizes) + np.arange(sizes.sum())
            i, x, row = index[at].astype(np.int64), value[at], np.repeat(np.arange(len(rows)), sizes)
            raw, sums = model.raw(i, x, first)
            error = (model.sigmoid(raw) - labels[rows]) / len(rows)
            seen, inverse = np.unique(i, return_inverse=True)
            ex = (error[row] * x).astype(np.float32)
            w_step = np.bincount(inverse, weights=ex, minlength=len(seen)) + SHRINK * model.w[seen]
            slope = ex[:, None] * (sums[row] - model.v[i] * x[:, None])
            v_step = np.stack([np.bincount(inverse, weights=slope[:, f], minlength=len(seen)) for f in range(RANK)], axis=1) + SHRINK * model.v[seen]
            g0 += error.sum() ** 2
            gw[seen] += w_step**2
            gv[seen] += v_step**2
            model.w0 -= RATE * error.sum() / np.sqrt(g0)
            model.w[seen] -= (RATE * w_step / np.sqrt(gw[seen])).astype(np.float32)
            model.v[seen] -= (RATE * v_step / np.sqrt(gv[seen])).astype(np.float32)
    return model


def held_out(id_col: str) -> Column:
    """True for rows whose crc32(id as text) mod 3 is 1. A null id counts as empty text, which isn't held out."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 3 == 1


def metadata(columns: list[Column]) -> Column:
    """One text of all metadata values; a null value is left out."""
    return F.concat_ws("\x1f", *(F.concat(F.lit(f"{i}="), c.cast("string")) for i, c in enumerate(columns))) if columns else F.lit("")


def length_class(n: str) -> Column:
    """Metadata for a count: its order of magnitude; null where it is null or negative."""
    return F.when(F.col(f"`{n}`") >= 0, F.floor(F.log2(F.col(f"`{n}`") + 1)))


def training_features(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", meta: list[Column] = (), max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(id, text_hash, y, index, value): the packed features of the texts to fit on, each once; see train()."""
    ship_package(docs.sparkSession)
    usable = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
    usable = usable.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("id", "y")
    lot, of_all = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30)), 1 << 30
    n = usable.count()
    if n > max_rows:
        usable = usable.where(lot("id") < int(of_all * max_rows / n))
    drawn = written(usable, "training-labels")  # its size is bounded by max_rows
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"), metadata(list(meta)).alias("meta"), text_of(text_col).alias("text"))
    rows = named.join(F.broadcast(drawn), "id")
    # An id may have any number of rows: the texts are drawn too, each (id, text, metadata) once.
    found = written(rows.groupBy("id", "text_hash", "meta").agg(F.count("*").alias("n")), "training-rows")
    n = found.count()
    share = min(1.0, max_rows / n) if n else 1.0

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, metas = list(batch["text"]), list(batch["meta"])
            for a, b in blocks_of(texts):
                index, value, starts = features(texts[a:b], metas[a:b])
                packed = [[x.tobytes() for x in np.split(y, starts[1:])] for y in (index.astype(INDEX), value.astype(VALUE))]
                yield batch.iloc[a:b][["id", "text_hash", "meta", "y"]].assign(id=batch["id"].iloc[a:b].astype(str), index=packed[0], value=packed[1])

    chosen = rows.where(lot("id", "text_hash", "meta", F.lit(1)) < int(of_all * share))
    packed = chosen.mapInPandas(extract, "id string, text_hash long, meta string, y int, index binary, value binary")
    packed = written(packed.dropDuplicates(["id", "text_hash", "meta"]), "training-features")
    size = packed.agg(F.sum(F.length("index") + F.length("value"))).first()[0] or 0
    if size > max_bytes:
        packed = packed.where(lot("id", "text_hash", "meta", F.lit(2)) < int(of_all * max_bytes / size))
    return packed


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", meta: list[Column] = (), max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """A model from the labels (0 or 1) of rows that aren't held out.

    An id with different labels, a null one, or other values teach nothing. Rows that agree in id, text and metadata teach once. Beyond ``max_rows`` usable labels, or
    texts that have one, a share of them is drawn by a hash, and again beyond ``max_bytes`` of features (six bytes for each bucket of a text, so a text of any length has 200 kB at most). Only
    those texts' features come to the driver.
    """
    packed = training_features(docs, labels, label_col, id_col, text_col, meta, max_rows, max_bytes)
    # Packed, in a few buffers, is all that the driver holds.
    got = packed.toArrow().sort_by([(c, "ascending") for c in ("id", "text_hash", "meta")])
    index, value = (np.frombuffer(b"".join(x.as_py() for x in got[c]), dtype=kind) for c, kind in (("index", INDEX), ("value", VALUE)))
    sizes = np.fromiter((len(x.as_py()) // INDEX.itemsize for x in got["index"]), dtype=np.int64, count=got.num_rows)
    return fit(index, value, np.cumsum(sizes) - sizes, got["y"].to_numpy())


def scored(docs: DataFrame, model: Model, text_col: str = "text", meta: list[Column] = (), out: str = "score") -> DataFrame:
    """``docs``, all columns and rows, with a double ``out`` from 0 to 1, higher where label 1 is likelier.

    Null and empty texts are scored too, as empty. Equal texts with equal metadata score alike. A column of the input named like ``out`` is replaced.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, metas in batches:
            yield pd.Series(shared.value.scores(list(texts), list(metas)))

    return docs.withColumn(out, score(text_of(text_col), metadata(list(meta))))
