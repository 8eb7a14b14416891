"""Target-distribution importance resampling (after DSIR, Xie et al., 2023) with n-gram hashes from prefix CRCs.

A document is reduced to its words, joined by one space, and scanned once for the running CRC-32 at the end of each word. The CRC
of any run of words follows from two of these: crc(B) = crc(AB) ^ Z(crc(A)), where Z appends as many zero bytes as B has and is linear over GF(2). Z for
a length is composed of those for its powers of two, each kept as four tables of 256 words, so a whole document's n-grams are hashed by array operations, of
every length of n-gram from the one scan.

Buckets of the hashes are counted over all documents and over the target; the log ratio of the two smoothed shares is a bucket's gain, a document's weight the
mean gain of its n-grams. Gumbel noise from a hash of the id makes the highest scores a sample without replacement in proportion to exp(weight). The draw sorts only what can be drawn, by range,
and numbers the rows from the sizes of the ranges: no task orders more than its own range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import ship_package, text_of, written

#: Lengths of the runs of words, from and to; buckets of their hashes.
ORDERS, BUCKETS = (1, 1), 10_000
#: Words that a document needs to be drawn; hundredths of such documents to draw; seed of the noise.
MIN_WORDS, PERCENT, SEED = 20, 10, 2024
#: Gains, weights and scores are whole thousandths.
UNITS = 1000
#: Everything but digits, letters and what isn't ASCII ends a word; A-Z count as a-z. Fixed for each byte.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bits that number the rows of one range.
ROW_BITS = 33


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLDED).split()


@lru_cache(maxsize=64)
def zeros(power: int) -> np.ndarray:
    """What 2 ** power zero bytes do to each byte of a CRC: four tables of 256."""
    if power == 0:
        first = np.array([crc32(bytes([b])) ^ crc32(b"\0") for b in range(256)], dtype=np.uint32)
        # A CRC moves down by one byte; only its lowest goes through the polynomial.
        return np.stack([first, *(np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(3))])
    half = zeros(power - 1)
    return np.stack([_applied(half, t) for t in half])


def _applied(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    out = tables[0][crcs & 255]
    for k in (1, 2, 3):
        out = out ^ tables[k][crcs >> np.uint32(8 * k) & 255]
    return out


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC with so many zero bytes appended."""
    out = crcs.copy()
    for power in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero(lengths >> power & 1)
        out[at] = _applied(zeros(power), out[at])
    return out


class Prefixes:
    """The running CRCs of a document's words joined by one space, and the places in bytes where they stand."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        running = accumulate(words[1:], lambda crc, word: crc32(word, crc32(b" ", crc)), initial=crc32(words[0])) if n else ()
        self.ends = np.fromiter(running, dtype=np.uint32, count=n)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        self.end_at = np.cumsum(lengths + 1) - 1
        self.start_at = self.end_at - lengths
        # The prefix before a word is the one after the word before it, and a space.
        self.starts = np.zeros(n, dtype=np.uint32)
        turned = ~self.ends[:-1]
        self.starts[1:] = ~(zeros(0)[0][(turned ^ np.uint32(32)) & 255] ^ turned >> np.uint32(8))

    def runs(self, n: int) -> np.ndarray:
        """The CRC-32 of every run of ``n`` words."""
        if n > len(self.ends):
            return np.zeros(0, dtype=np.uint32)
        last = len(self.ends) - n + 1
        return self.ends[n - 1 :] ^ shifted(self.starts[:last], self.end_at[n - 1 :] - self.start_at[:last])


def buckets_of(text: str, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every run of words."""
    prefixes = Prefixes(words_of(text))
    found = [prefixes.runs(n) for n in range(orders[0], orders[1] + 1)]
    return len(prefixes.ends), np.concatenate(found).astype(np.int64) % buckets


def bucket_counts(docs: DataFrame, text_col: str = "text", orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of words of all texts fall into each bucket. A task sends one row for each bucket at most."""
    ship_package(docs.sparkSession)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                counts += np.bincount(buckets_of(text, orders, buckets)[1], minlength=buckets)
        yield pd.DataFrame({"bucket": np.flatnonzero(counts), "n": counts[counts > 0]})

    found = docs.select(text_of(text_col).alias("text")).mapInPandas(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in found.collect():
        out[bucket] = n
    return out


def gains(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log ratio of a bucket's share in the target to its share in the documents, one added to every count; whole thousandths, rounded down."""
    rows, goal, more = float(counts.sum()), float(target.sum()), float(len(counts))
    of = lambda s, t: math.floor(UNITS * math.log((t + 1.0) * (rows + more) / ((s + 1.0) * (goal + more))))
    return np.array([of(float(s), float(t)) for s, t in zip(counts, target)], dtype=np.int64)


def resample(
    docs: DataFrame,
    target: DataFrame,
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    orders: tuple[int, int] = ORDERS,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """Every row of ``docs``: the columns ``keep`` (all where None), n_features, weight, score, and its rank where it is drawn.

    Drawn are ``percent`` hundredths, rounded down, of the documents with at least ``min_words`` words: those with the highest scores.

    Null and empty texts have no words and no features, and weigh 0; they are scored but not drawn, unless ``min_words`` is 0. A null id draws its noise as an empty one. Equal
    scores go by the smaller id, null last; rows that agree in these too are numbered in any order, each once. Repeated rows stay apart. An empty target counts nothing (the gains then only even out the
    documents' own counts); an empty table gives an empty one. Texts of any length are scanned whole; a task holds one text's words at a time. Columns with one of the four names, in any case,
    are replaced; all others come through.
    """
    ship_package(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_features", "weight", "score", "rank")]
    gain = gains(bucket_counts(docs, text_col, orders, buckets), bucket_counts(target, target_text_col, orders, buckets))

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weighed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = np.zeros((len(texts), 3), dtype=np.int64)
            for i, text in enumerate(texts):
                n, found = buckets_of(text, orders, buckets)
                rows[i] = n, len(found), int(gain[found].sum()) // max(1, len(found))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])

    id_text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(UNITS)) * F.log(-F.log((drawn + F.lit(0.5)) / F.lit(float(1 << 32)))))
    kept = [f"in_{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)), F.col(f"`{id_col}`").alias("id"), noise.alias("noise"), weighed(text_of(text_col)).alias("w"))
    rows = rows.select(*kept, "id", "w.n_words", "w.n_features", "w.weight", (F.col("w.weight") + F.col("noise")).alias("score"), F.monotonically_increasing_id().alias("row"))
    return _ranked(written(rows, "scored"), min_words, percent).select(*(F.col(k).alias(c) for c, k in zip(keep, kept)), "n_features", "weight", "score", "rank")


def _ranked(scored: DataFrame, min_words: int, percent: int) -> DataFrame:
    """``scored`` with the rank of what is drawn.

    Scores are whole thousandths of log ratios and of a noise of 32 bits, some 100,000 values at most however many rows there are, so their counts fit the driver and give the
    least score that is drawn.
    """
    may = F.col("n_words") >= min_words
    counts = sorted(scored.where(may).groupBy("score").agg(F.count("*").alias("n")).collect(), reverse=True)
    room = percent * sum(n for _, n in counts) // 100
    least, so_far = None, 0
    for score, n in counts:
        if so_far >= room:
            break
        least, so_far = score, so_far + n
    none = F.lit(None).cast("long")
    if least is None:
        return scored.withColumn("rank", none)
    reached = may & (F.col("score") >= least)
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    ranged = scored.where(reached).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "ranges").withColumn("range", F.shiftright("at", ROW_BITS))
    before, offsets = 0, []
    for part, n in sorted(ranged.groupBy("range").agg(F.count("*")).collect()):
        offsets.append((part, before))
        before += n
    ranged = ranged.join(F.broadcast(spark.createDataFrame(offsets, "range long, before long")), "range")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    ranged = ranged.withColumn("rank", F.when(rank <= room, rank)).select(*scored.columns, "rank")
    return ranged.unionByName(scored.where(~reached).withColumn("rank", none))
