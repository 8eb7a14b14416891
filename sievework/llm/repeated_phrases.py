"""Substring dedup by repeated-phrase automata.

A window of words goes where the same words already stand earlier, in a document of smaller id or further up in the same one. The work follows what recurs, not what there is:

1. Sketches. Each window is represented by an anchor, the run of ANCHOR words in it whose hash is least (winnowing: Schleimer et al., 2003), so that equal windows have equal
   anchors, at the same place. Only anchors are counted over all documents, about one for seven words; equal texts count once.
2. Confirming. Around an anchor that recurs, the windows that it represents make a stretch of a few more words than a window. Equal stretches are one phrase; windows of all phrases are
   counted by 128 bits, with the first place of each. Windows that stand in two places or more are confirmed.
3. Automata. Phrases are dealt by their anchor to shards. A shard's confirmed windows (neighbours that only one phrase has, as one pattern) are compiled into an Aho-Corasick automaton over word numbers, at most about SHARD of them, and
   every phrase of the shard streams through it. The automaton compares words, so hashes decide nothing by themselves. An anchor with more than CROWDED phrases is dealt by the
   windows' own words instead, so no shard holds all that a crowded anchor has.
4. The answer for a phrase goes to each document that has it, which compares the first places with its own.

Whole copies of a text need none of this: all their windows stand in the first copy. What is joined to the documents is a list of word ranges for each text, sent to all tasks
where it is small (measured), else documents are shuffled to meet it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import scratch, shared_path, ship_package, text_of, written
from sievework.llm.mph import STEP, _mixed

#: Words of a window; of an anchor.
WINDOW, ANCHOR = 20, 8
#: Confirmed windows of a shard; phrases of one anchor from which they are dealt by window.
SHARD, CROWDED = 20_000, 2_000
#: Bytes that are sent to all tasks instead of moving what they are joined to.
SENT_BYTES = 32 << 20
#: Words whose hashes a task remembers; windows whose anchors are found at once.
KNOWN, BLOCK = 1 << 16, 1 << 20
#: Stretches that a task cuts at once; rows and bytes from which it hands them on. Where every anchor recurs they take over three times the bytes of the texts.
CUT, ROWS, BYTES = 256, 20_000, 8 << 20
SEED = 11


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def grams(words: list[bytes], known: _Hashes, width: int = ANCHOR) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = out * STEP + hashes[i : i + n]
    return _mixed(out)


def anchors_at(grams: np.ndarray, of: int) -> np.ndarray:
    """For each ``of`` neighbouring grams the place of the least, the leftmost of equal ones."""
    found = []
    for a in range(0, max(0, len(grams) - of + 1), BLOCK):
        best = grams[a : a + BLOCK + of - 1]
        at, have = np.arange(a, a + len(best)), 1
        while have < of:
            step = min(have, of - have)
            less = best[step:] < best[:-step]
            best, at, have = np.where(less, best[step:], best[:-step]), np.where(less, at[step:], at[:-step]), have + step
        found.append(at)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def words_of(text: str) -> list[bytes]:
    return text.encode().split()  # of bytes: exactly the six ASCII blanks


def _runs(ordered: str, out: str, by: int = 1) -> list[Column]:
    """The first and last members of runs of whole numbers in an array column without repeats."""
    col = F.col(ordered)
    first = F.filter(col, lambda x, i: (i == 0) | (F.get(col, i - 1) < x - 1))
    last = F.filter(col, lambda x, i: (i == F.size(col) - 1) | (F.get(col, i + 1) > x + 1))
    return [first.alias(f"{out}_from"), last.alias(f"{out}_to")]


def _sent_if_small(df: DataFrame, bytes_: Column, most: int) -> DataFrame:
    """``df`` (written), to be broadcast where its measured bytes allow it."""
    total = df.agg(F.sum(bytes_)).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def _sketch(window: int):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            found = []
            for text in batch["text"]:
                g = grams(words_of(text), known)
                found.append(g[np.unique(anchors_at(g, window - ANCHOR + 1))].view(np.int64))
            yield pd.DataFrame({"name": batch["name"], "id": batch["id"], "anchors": found})

    return sketch


def _stretch(window: int):
    """Texts and the recurring ones among their anchors, as runs of their numbers -> the stretches of words around these."""

    def stretch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            found: dict[str, list] = {c: [] for c in ("anchor", "phrase", "words", "no", "at")}
            held = 0
            for no, text, firsts, lasts in zip(batch["no"], batch["text"], batch["anchor_from"], batch["anchor_to"]):
                words = words_of(text)
                g = grams(words, known)
                at = anchors_at(g, window - ANCHOR + 1)
                # Windows that share an anchor are neighbours, as anchors never go back.
                starts = np.flatnonzero(np.diff(at, prepend=-1))
                ends = np.append(starts[1:], len(at)) + window - 1
                numbers = np.concatenate([np.arange(a, b + 1) for a, b in zip(firsts, lasts)])
                for i in range(0, len(numbers), CUT):
                    some = numbers[i : i + CUT]
                    joined = [b" ".join(words[a:b]) for a, b in zip(starts[some].tolist(), ends[some].tolist())]
                    for c, values in (("anchor", g[at[starts[some]]].view(np.int64)), ("phrase", map(xxhash.xxh128_digest, joined)), ("words", joined), ("no", [no] * len(joined)), ("at", starts[some])):
                        found[c].extend(values)
                    held += sum(map(len, joined))
                    if len(found["no"]) >= ROWS or held >= BYTES:
                        yield pd.DataFrame(found)
                        found, held = {c: [] for c in found}, 0
            if found["no"]:
                yield pd.DataFrame(found)

    return stretch


def _windows(window: int):
    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes, offsets = [], []
            for joined in batch["words"]:
                words = joined.split(b" ")
                ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
                slices = zip(ends[: len(words) - window + 1], ends[window:])
                hashes.extend(xxhash.xxh128_digest(joined[a + 1 : b]) for a, b in slices)
                offsets.append(len(words) - window + 1)
            row = np.repeat(np.arange(len(batch)), offsets)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(offsets) - offsets, offsets)
            yield pd.DataFrame({"hash": hashes, "offset": offset, **{c: batch[c].to_numpy()[row] for c in ("no", "at", "n")}})

    return windows


def runs(offsets, alone) -> list[tuple[int, int]]:
    """Confirmed windows as patterns: neighbours that no other phrase has are one, with their number."""
    out: list[tuple[int, int]] = []
    open_ = False
    for o, only in zip(offsets, alone):
        if open_ and only and out[-1][0] + out[-1][1] == o:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((int(o), 1))
        open_ = only
    return out


def _located(window: int):
    """Rows in order of shard, patterns before texts: each shard's patterns are compiled, then its texts stream through."""

    def located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, numbers, places, automaton, ready = None, {}, [], None, False
        for batch in batches:
            out = []
            for at_shard, is_text, words, offsets, alone, no, at, phrase, offset in zip(*(batch[c] for c in ("shard", "is_text", "words", "offsets", "alone", "no", "at", "phrase", "offset"))):
                if at_shard != shard:
                    shard, numbers, places, ready = at_shard, {}, [], False
                    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
                said = words.split(b" ")
                if not is_text:
                    key = [numbers.setdefault(w, len(numbers) + 1) for w in said]
                    for o, n in runs(offsets, alone):
                        automaton.add_word(tuple(key[o : o + n + window - 1]), len(places))
                        places.append((no, at + o, n))
                    continue
                if not places:
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                # Neighbouring windows that first stand side by side are one row.
                last = None
                for end, i in automaton.iter(tuple([numbers.get(w, 0) for w in said])):
                    first_no, first_at, n = places[i]
                    o = offset + end - window - n + 2
                    if last and last[1] + last[2] == o and last[3] == first_no and last[4] + last[2] == first_at:
                        last[2] += n
                    else:
                        out.append(last := [phrase, o, n, first_no, first_at])
            yield pd.DataFrame(out, columns=["phrase", "offset", "windows", "first_no", "first_at"])

    return located


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard: int = SHARD, crowded: int = CROWDED, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """For each text that has something to lose: name, its first id, removed_from and removed_to (first and last words of each range).

    A row of another id with the same text loses all of it.
    """
    spark = docs.sparkSession
    ship_package(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.unhex(F.md5(text_of(text_col).cast("binary"))).alias("name"), F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))

    path = shared_path(spark, "repeats")
    with scratch(spark):
        return written(_decided(rows, id_type, window, shard, crowded, sent_bytes), "repeats", path)


def _decided(rows: DataFrame, id_type: str, window: int, shard: int, crowded: int, sent_bytes: int) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The number of a text follows the order of the places: by id, null last, then name.
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "n")
    names = rows.groupBy("name", "id").agg(F.count("*").alias("n")).groupBy("name").agg(F.min(place).alias("first"), F.count("*").alias("ids"))
    order = ["unnamed", "id", "name"]
    names = names.select("name", "first.*", (F.col("ids") > 1).alias("copied")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    names = written(names.select("name", "id", "n", "copied", F.monotonically_increasing_id().alias("no")), "names")
    firsts = names.select(F.col("name").alias("first_name"), F.col("id").alias("first_id"), "n", "no")
    is_first = (F.col("name") == F.col("first_name")) & F.col("id").eqNullSafe(F.col("first_id"))

    sketches = rows.mapInPandas(_sketch(window), f"name binary, id {id_type}, anchors array<long>").where("size(anchors) > 0")
    sketches = written(sketches.join(_sent_if_small(firsts, F.lit(64), sent_bytes), is_first).select("no", "anchors"), "sketches")
    met = written(sketches.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "met-anchors")
    numbered = sketches.select("no", F.posexplode("anchors").alias("number", "anchor")).join(_sent_if_small(met, F.lit(32), sent_bytes), "anchor", "left_semi")
    zones = numbered.groupBy("no").agg(F.array_sort(F.collect_set("number")).alias("numbers")).select("no", *_runs("numbers", "anchor"))
    zones = written(zones.join(firsts, "no"), "zones")
    near = rows.join(_sent_if_small(zones, 80 + 8 * F.size("anchor_from"), sent_bytes), is_first)
    # Rows that agree in id and text are one document.
    near = near.where("n = 1") if zones.where("n > 1").isEmpty() else near.where("n = 1").unionByName(near.where("n > 1").dropDuplicates(["no"]))
    near = near.select("no", "text", "anchor_from", "anchor_to")
    stretches = written(near.mapInPandas(_stretch(window), "anchor long, phrase binary, words binary, no long, at int"), "stretches")

    phrases = stretches.groupBy("phrase").agg(F.min(F.struct("no", "at")).alias("place"), F.count("*").alias("n"), F.first("anchor").alias("anchor"), F.first("words").alias("words"))
    phrases = written(phrases.select("phrase", "anchor", "words", "place.no", "place.at", "n"), "phrases")
    counted = phrases.select("words", "no", "at", "n").mapInPandas(_windows(window), "hash binary, offset int, no long, at int, n long")
    confirmed = counted.groupBy("hash").agg(F.min(F.struct("no", "at", "offset")).alias("place"), F.sum("n").alias("n"), F.count("*").alias("phrases")).where("n > 1")
    confirmed = confirmed.groupBy("place.no", "place.at").agg(F.sort_array(F.collect_list(F.struct("place.offset", (F.col("phrases") == 1).alias("alone")))).alias("c"))
    confirmed = written(confirmed.select("no", "at", F.col("c.offset").alias("offsets"), F.col("c.alone").alias("alone")), "confirmed")

    shards = max(1, -(-(confirmed.agg(F.sum(F.size("offsets"))).first()[0] or 0) // shard))
    full = written(phrases.groupBy("anchor").agg(F.count("*").alias("under")).where(F.col("under") > crowded).select("anchor", F.lit(True).alias("full")), "crowded-anchors")
    of = phrases.join(confirmed, ["no", "at"], "left").join(_sent_if_small(full, F.lit(32), sent_bytes), "anchor", "left")
    whole = of.where("full is null").select(F.col("anchor").alias("key"), "words", "offsets", "alone", "no", "at", "phrase", F.lit(0).alias("offset"))
    each = of.where("full").withColumn("said", F.split(F.col("words").cast("string"), " ")).withColumn("offset", F.explode(F.sequence(F.lit(0), F.size("said") - window)))
    single = F.array_join(F.slice("said", F.col("offset") + 1, window), " ").cast("binary")
    own = F.when(F.array_contains("offsets", F.col("offset")), F.array(F.lit(0)))
    each = each.select(F.xxhash64(single).alias("key"), single.alias("words"), own.alias("offsets"), F.when(own.isNotNull(), F.array(F.lit(False))).alias("alone"), "no", (F.col("at") + F.col("offset")).alias("at"), "phrase", "offset")
    both = whole.unionByName(each).withColumn("is_text", F.explode(F.when(F.col("offsets").isNull(), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))))
    dealt = both.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).repartition(parts, "shard").sortWithinPartitions("shard", "is_text")
    answers = written(dealt.mapInPandas(_located(window), "phrase binary, offset int, windows int, first_no long, first_at int"), "answers")

    start = F.col("at") + F.col("offset")
    held = stretches.select("phrase", "no", "at").join(answers, "phrase")
    later = held.where((F.col("first_no") < F.col("no")) | ((F.col("first_no") == F.col("no")) & (F.col("first_at") < start)))
    marks = later.groupBy("no").agg(F.array_sort(F.collect_list(F.struct(start.alias("from"), (start + F.col("windows") + window - 2).alias("to")))).alias("m"))

    @F.pandas_udf("removed_from array<int>, removed_to array<int>")
    def merged(firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(firsts, lasts):
            reach = np.maximum.accumulate(b)
            opens = np.flatnonzero(np.append(True, a[1:] > reach[:-1] + 1))
            out.append((a[opens], reach[np.append(opens[1:], len(a)) - 1]))
        return pd.DataFrame(out, columns=["removed_from", "removed_to"])

    marks = marks.select("no", merged("m.from", "m.to").alias("r")).select("no", "r.*")
    return names.join(marks, "no", "left").where("copied or removed_from is not null").select("name", F.col("id").alias("first_id"), "removed_from", "removed_to", F.lit(True).alias("decided"))


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard: int = SHARD, crowded: int = CROWDED, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Every row of ``docs``: the columns ``keep`` (all where None), n_words, n_removed, kept (what stays, joined by one space), removed_from and removed_to (the ranges of words that go, first and last).

    A word goes if it lies in a window whose words also start earlier: in a text of smaller id, or further up in the same text. Windows are judged on the input. Texts of fewer than ``window`` words, null and empty ones too,
    lose nothing. Null ids come after all others. Among rows that share an id, different texts go by their hash; rows that agree in id and text are one document, repeated, and keep the same words. An empty table
    gives an empty one. Texts of any length are taken whole; a task holds one text's words at a time. Columns with one of the five names, in any case, are replaced; all others come through. ``window`` is more than ANCHOR words.
    """
    if window <= ANCHOR:
        raise ValueError(f"a window needs more than {ANCHOR} words")
    decided = repeats(docs, id_col, text_col, window, shard, crowded, sent_bytes)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_words", "n_removed", "kept", "removed_from", "removed_to")]
    kept = [f"in_{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)), F.unhex(F.md5(text_of(text_col).cast("binary"))).alias("name"), F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    rows = rows.join(_sent_if_small(decided, 80 + 8 * F.coalesce(F.size("removed_from"), F.lit(0)), sent_bytes), "name", "left")
    # A copy goes whole: from the first word to the last there can be.
    copy = F.coalesce("decided", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("first_id"))

    @F.pandas_udf("n_words long, n_removed long, kept string, removed_from array<int>, removed_to array<int>")
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, copies, firsts, lasts in batches:
            out = []
            for text, whole, a, b in zip(texts, copies, firsts, lasts):
                words = words_of(text)
                n = len(words)
                spans = [(0, n - 1)] if whole and n >= window else [] if whole or a is None else list(zip(a, b))
                left, last = [], 0
                for x, y in spans:
                    left, last = left + words[last:x], y + 1
                left += words[last:]
                out.append((n, n - len(left), b" ".join(left).decode(), [int(x) for x, _ in spans], [int(y) for _, y in spans]))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept", "removed_from", "removed_to"])

    found = rows.select(*kept, cut("text", copy, "removed_from", "removed_to").alias("cut"))
    return found.select(*(F.col(k).alias(c) for c, k in zip(keep, kept)), "cut.*")
