"""Lines that many documents share, dropped by way of a sharded minimal perfect hash.

One pass counts, for each distinct line hash (128 bits), the documents that have it. All distinct hashes are dealt into
shards by their top bits, and each shard becomes a minimal perfect hash over them with an array of 64-bit fingerprints and
one of 32-bit counts. A second pass takes each document's lines and probes the arrays; whether a line drops is decided by the count that it reads there. A hash that isn't
in the index lands on some slot, and its fingerprint tells it apart.

If the arrays' size, which is measured, is within ``broadcast_bytes``, they are broadcast. Otherwise the documents' line hashes are
sent to the shards, each text named by a hash, and those that drop come back: as a small index of their own that is
broadcast if it is within the same bound, else by the texts' names. The hashes that hold more than a 100,000th of all lines, at most so many, are answered
before anything is sent, so no shard is asked for one line without end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import mph
from sievework.llm.common import ship_package, text_of, written

#: Documents with a line from which it is dropped, and the least code points of its key.
MIN_DOCS, MIN_CHARS = 10, 1
#: Keys of one shard; most bytes of arrays to broadcast; the share of all lines, as one in so many, from which a hash is hot.
SHARD_KEYS, BROADCAST_BYTES, HOT = 1 << 18, 4 << 20, 100_000
BLANKS = b" \t\n\x0b\x0c\r"
INDEX = "shard int, n long, sizes array<long>, bits binary, fingerprints binary, counts binary"


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII blanks, A-Z in lower case."""
    return line.strip(BLANKS).lower()


def digests(keys: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([h(k) for k in keys]), dtype="<u8").reshape(-1, 2)


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def _counter(min_chars: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = xxhash.xxh3_128_digest
        for batch in batches:
            docs: Counter = Counter()
            for text in batch["text"]:
                docs.update({h(k) for k in {line_key(x) for x in text.encode().split(b"\n")} if long_enough(k, min_chars)})
            found = np.frombuffer(b"".join(docs), dtype="<u8").reshape(-1, 2).astype(np.uint64)
            yield pd.DataFrame({"h1": found[:, 0].view(np.int64), "h2": found[:, 1].view(np.int64), "n": np.fromiter(docs.values(), dtype=np.int64, count=len(docs))})

    return count


def _unsigned(x) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint64)


def _build_shard(keys: pd.DataFrame) -> pd.DataFrame:
    index = mph.build(_unsigned(keys["h1"]), _unsigned(keys["h2"]), keys["n"].to_numpy())
    return pd.DataFrame([{"shard": keys["shard"].iat[0], "n": len(keys)} | index])


class Shards:
    """All shards of an index, by their number."""

    def __init__(self, shard_bits: int, rows: list):
        self.shard_bits = shard_bits
        self.rows = {r["shard"]: (r["sizes"], bytes(r["bits"]), bytes(r["fingerprints"]), bytes(r["counts"])) for r in rows}
        self.ready: dict = {}

    def __getstate__(self):
        return {"shard_bits": self.shard_bits, "rows": self.rows, "ready": {}}

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), dtype=np.int64)
        shard = keys[:, 0] >> np.uint64(64 - self.shard_bits)
        for s in np.unique(shard).tolist():
            if s in self.rows:
                if s not in self.ready:
                    self.ready[s] = mph.Index(*self.rows[s])
                at = np.flatnonzero(shard == s)
                found[at] = self.ready[s].lookup(keys[at, 0], keys[at, 1])
        return found


def line_counts(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, n): the distinct hashes of line keys of ``min_chars`` code points or more, and the documents that have them."""
    ship_package(docs.sparkSession)
    counted = docs.select(text_of(text_col).alias("text")).mapInPandas(_counter(min_chars), "h1 long, h2 long, n long")
    return written(counted.groupBy("h1", "h2").agg(F.sum("n").alias("n")), "line-counts")


def line_index(counts: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, int]:
    """The sharded index of all hashes (h1, h2, n), the bits of a hash that name its shard, and the bytes of its arrays."""
    bits = max(3, (counts.count() // shard_keys).bit_length())
    sharded = counts.withColumn("shard", F.shiftrightunsigned("h1", 64 - bits).cast("int"))
    index = written(sharded.groupBy("shard").applyInPandas(_build_shard, INDEX), "line-index")
    return index, bits, index.agg(F.sum(F.length("bits") + F.length("fingerprints") + F.length("counts"))).first()[0] or 0


def _kept(texts, dropped_of) -> pd.DataFrame:
    """dropped_of: all keys of the batch -> whether each drops."""
    lines = [t.split("\n") for t in texts]
    drops = dropped_of([line_key(x.encode()) for ls in lines for x in ls])
    rows, at = [], 0
    for t, ls in zip(texts, lines):
        own = drops[at : at + len(ls)]
        at += len(ls)
        n = int(np.count_nonzero(own))
        rows.append((len(ls), n, "\n".join(x for x, d in zip(ls, own.tolist()) if not d) if n else t))
    return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])


#: The columns that drop_common_lines() makes.
KEPT = "n_lines long, n_dropped long, kept string"


def _probe(shared, min_docs: int):
    @F.pandas_udf(KEPT)
    def probe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield _kept(texts, lambda keys: shared.value.lookup(digests(keys)) >= min_docs)

    return probe


def _hash_lines(hot):
    """The hashes of each text's lines that aren't hot; of equal texts of a batch once."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.drop_duplicates("name")
            of_text = [list({line_key(x) for x in text.encode().split(b"\n")}) for text in batch["text"]]
            found = digests([k for keys in of_text for k in keys]).astype(np.uint64)
            names = np.repeat(batch["name"].to_numpy(), [len(keys) for keys in of_text])
            cold = hot.value.lookup(found) == 0
            yield pd.DataFrame({"name": names[cold], "h1": found[cold, 0].view(np.int64), "h2": found[cold, 1].view(np.int64)})

    return ask


def _probe_routed(min_docs: int):
    """Of a shard the arrays come first, then what is asked of them; a task holds one shard's arrays at a time."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, shard = None, None
        for batch in batches:
            for own, rows in batch.groupby("shard", sort=False):
                built = rows[rows["bits"].notna()]
                if own != shard or len(built):
                    index, shard = (mph.Index(*built.iloc[0][["sizes", "bits", "fingerprints", "counts"]]) if len(built) else None), own
                asked = rows[rows["bits"].isna()]
                if index is not None and len(asked):
                    n = index.lookup(_unsigned(asked["h1"]), _unsigned(asked["h2"]))
                    yield asked.assign(n=n).loc[n >= min_docs, ["name", "h1", "h2", "n"]]

    return probe


def _drop_given(hot, min_docs: int):
    @F.pandas_udf(KEPT)
    def drop(texts: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        out = []
        for t, a, b in zip(texts, h1, h2):
            gone = set() if a is None else set(zip(a.tolist(), b.tolist()))

            def dropped(keys: list, gone=gone) -> np.ndarray:
                found = digests(keys).astype(np.uint64)
                return np.array([tuple(k) in gone for k in found.view(np.int64).tolist()], dtype=bool) | (hot.value.lookup(found) >= min_docs)

            out.append(_kept([t], dropped))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c.split()[0]: [] for c in KEPT.split(", ")})

    return drop


def drop_common_lines(docs: DataFrame, keep: list[str], text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_lines (before), n_dropped and kept (the text that is left).

    Lines are split at \\n only; a null or empty text is one empty line. A line's key is the line without ASCII blanks at
    its ends, A-Z in lower case; keys of ``min_chars`` code points or more that ``min_docs`` rows or more have lose all
    their lines. Rows are documents, repeated ones too, so there are no ties. Ids aren't looked at: answers come back to a text by
    its hash, and equal texts have equal answers. Columns in ``keep`` named like one that is made are replaced; others are not
    read. An empty table gives an empty result. A text of any length is split whole; a task holds one batch of texts and their lines' hashes.
    """
    made = [c.split()[0] for c in KEPT.split(", ")]
    keep = [c for c in keep if c.lower() not in made]
    spark, text = docs.sparkSession, text_of(text_col)
    counts = line_counts(docs, text_col, min_chars)
    index, bits, size = line_index(counts, shard_keys)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(keep)), text.alias("text"))
    out = [*(F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)), "lines.*"]

    def broadcast(index: DataFrame, bits: int):
        return spark.sparkContext.broadcast(Shards(bits, index.collect()))

    if size <= broadcast_bytes:
        return rows.withColumn("lines", _probe(broadcast(index, bits), min_docs)("text")).select(out)

    total = counts.agg(F.sum("n")).first()[0] or 0
    few = counts.where((F.col("n") * HOT > total) & (F.col("n") >= min_docs))  # fewer than HOT of them can be
    hot = broadcast(*line_index(few, shard_keys)[:2])
    name = F.unhex(F.md5(text.cast("binary"))).alias("name")
    asked = docs.select(name, text.alias("text")).mapInPandas(_hash_lines(hot), "name binary, h1 long, h2 long").withColumn("shard", F.shiftrightunsigned("h1", 64 - bits).cast("int"))
    # No nulls among the hashes: pandas would turn the column into floats.
    zero = F.lit(0).cast("long")
    arrays = index.select("shard", zero.alias("h1"), zero.alias("h2"), "sizes", "bits", "fingerprints", "counts")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = arrays.unionByName(asked, allowMissingColumns=True).repartition(n, "shard").sortWithinPartitions("shard", F.col("bits").isNull())
    hits = written(both.mapInPandas(_probe_routed(min_docs), "name binary, h1 long, h2 long, n long"), "line-hits")

    gone = hits.groupBy("h1", "h2").agg(F.max("n").alias("n")).unionByName(few)
    dropping, gone_bits, gone_size = line_index(written(gone, "line-gone"), shard_keys)
    if gone_size <= broadcast_bytes:
        return rows.withColumn("lines", _probe(broadcast(dropping, gone_bits), min_docs)("text")).select(out)
    answers = written(hits.groupBy("name").agg(F.collect_set(F.struct("h1", "h2")).alias("gone")), "line-answers")
    named = rows.withColumn("name", F.unhex(F.md5(F.col("text").cast("binary"))))
    return named.join(answers, "name", "left").withColumn("lines", _drop_given(hot, min_docs)("text", "gone.h1", "gone.h2")).select(out)
