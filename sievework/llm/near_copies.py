"""Near copies at a stated similarity, with no link lost: the texts of one component of the graph of all pairs whose five-word Jaccard similarity is 0.8 or more.

A SimHash can't find them: at 0.8 two fingerprints are about 10 of 64 bits apart, beyond what any index of them holds at scale, and by chance more. So candidates come from the shingles by prefix
filtering (Chaudhuri et al., 2006), and op6's pigeonring chain only prunes them. Put in one order for all texts, the first n - ceil(0.8 n) + 1 of a text's n shingles are its prefix; two texts at 0.8
or more share a shingle of their prefixes, whatever the order. The order here is by hash, with the most frequent shingles (a bounded list of them, counted over all texts) last, so that what many texts say
is in few prefixes. Only prefix shingles that two texts share are kept, as keys.

Texts that share a key need not all be compared: what is in one component already is settled. The first round compares the texts of every key with the one that shares most with others, the same for all keys of
a group of copies, and joins components; further rounds do so for keys that are too large for one task. Pairs therefore grow with the texts, however many alike there are. In the end
all pairs of different components that are left are compared: those whose sizes allow 0.8 and whose fingerprints stay within the chain of budgets of MAX_BITS. Texts of few shingles have no fingerprint to go by; they are told apart by the parities of
their shingles in 256 places, of which no more differ than there are shingles that only one of the two has, so no pair at 0.8 is pruned by them. Under a key that leaves many pairs after that, they are put to the exact similarity at once, as bitsets, so that
near misses aren't handed on; a key with more than PIECE texts is split by their second common shingle, as prefixes longer by one share two.

Each candidate pair is put to the exact similarity over the shingles of its whole texts (64-bit hashes).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import place, scratch, ship_package, text_of, written
from sievework.llm.mph import STEP, _mixed
from sievework.llm.simhash_dedup import BLOCK, SEED, components, majority, within

#: Words of a shingle; the similarity, as a fraction.
WIDTH, SHARED, OF = 5, 4, 5
#: Texts that share a shingle from which it is put last; how many such shingles there are at most; shingles of a task's texts that are counted together, and texts of these that count.
FREQUENT, MOST_FREQUENT, CHUNK, SEVERAL = 24, 1 << 20, 1 << 21, 3
#: Parts of 64 bits of a fingerprint; bits in which those of two texts at 0.8 may differ, in the first part and in all: 10 and 39 are usual, these are more than six standard deviations off. It holds from so many shingles on;
#: fewer are compared by parities, which texts of less than MANY_SHINGLES have: a larger one is at 0.8 with none of so few.
PRINTS, MAX_BITS, ALL_BITS, LEAST_SHINGLES = 4, 28, 76, 64
MANY_SHINGLES = LEAST_SHINGLES * OF // SHARED
#: Bits of the filter of keys; the number of keys up to which it is used.
FILTER_BITS, FILTERED = 1 << 27, 1 << 24
#: What is told of a text under a key.
OWN = ["no", "label", "size", *(f"fp{k}" for k in range(PRINTS)), *(f"odd{k}" for k in range(PRINTS))]
#: Pairs that may be alike for each text under a key up to which they are handed on; rounds of comparing one text with the others at most, and the share of pairs that a round may leave if another is to follow;
#: texts under one key from which it is split.
FEW, ROUNDS, SLOW, PIECE = 32, 12, 0.7, 4_096
#: Bytes of the shingles under one key that one task compares.
GROUP_BYTES = 32 << 20
#: Bytes of the shingles that pairs take along up to which they are put to the exact similarity at once, if those of all their texts aren't more.
PART_BYTES = 32 << 20
#: Bytes that are sent to all tasks instead of moving what they are joined to; words whose hashes a task remembers; rows from which a task hands results on.
SENT_BYTES, KNOWN, ROWS = 16 << 20, 1 << 16, 50_000


class Hashes(dict):
    """The hashes of words, remembered up to a number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingles(text: str, known: Hashes, width: int = WIDTH) -> np.ndarray:
    """The hashes of the text's distinct word shingles, in order; one of all words where there are fewer than ``width``. A-Z count as a-z; blanks are the six of ASCII."""
    words = text.encode().lower().split()
    hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    n = len(words) - width + 1 if words else 0
    out = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        out = out * STEP + hashes[i : i + n]
    return np.unique(_mixed(out))


def prefix(ordered: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The prefix of a text's shingles and the one after it, frequent ones last."""
    n = len(ordered)
    size = min(n, n + 1 - -(-SHARED * n // OF) + 1)
    late = frequent[np.minimum(np.searchsorted(frequent, ordered), len(frequent) - 1)] == ordered if len(frequent) else np.zeros(n, dtype=bool)
    return ordered[np.concatenate([np.flatnonzero(~late)[:size], np.flatnonzero(late)[:size]])[:size]]


def _several(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shingles that several of a task's texts in a row have, and how many of them."""
    known, whole, held = Hashes(), [], 0

    def counts(whole: list[np.ndarray]) -> pd.DataFrame:
        key, n = np.unique(np.concatenate(whole), return_counts=True)
        return pd.DataFrame({"key": key[n >= SEVERAL].view(np.int64), "n": n[n >= SEVERAL]})

    for batch in batches:
        for text in batch["text"]:
            whole.append(shingles(text, known))
            held += len(whole[-1])
            if held >= CHUNK:
                yield counts(whole)
                whole, held = [], 0
    if whole:
        yield counts(whole)


def _tokens(frequent, shared):
    """no, text -> a row for each shingle of the longer prefix: key, no, extra (it is the one after the prefix). ``shared`` leaves most out that no other text has."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, bits = Hashes(), None if shared is None else shared.value
        for batch in batches:
            keys, nos, extras, held = [], [], [], 0
            for no, text in zip(batch["no"], batch["text"]):
                ordered = shingles(text, known)
                key = prefix(ordered, frequent.value)
                # A text of one shingle, or of which all may be needed, has none after its prefix.
                extra = np.arange(len(key)) >= len(ordered) - -(-SHARED * len(ordered) // OF) + 1
                if bits is not None:
                    at = (key & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                    some = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
                    key, extra = key[some], extra[some]
                keys.append(key.view(np.int64))
                nos.append(np.full(len(key), no))
                extras.append(extra)
                held += len(key)
                if held >= ROWS:
                    yield pd.DataFrame({"key": np.concatenate(keys), "no": np.concatenate(nos), "extra": np.concatenate(extras)})
                    keys, nos, extras, held = [], [], [], 0
            if held:
                yield pd.DataFrame({"key": np.concatenate(keys), "no": np.concatenate(nos), "extra": np.concatenate(extras)})

    return tokens


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bit for each value of the low bits of a key, as bytes: FILTER_BITS of them however many keys there are."""
    # Bitmaps count from 1.
    low = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(low).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(low)).alias("bits")).collect()
    out = np.zeros((FILTER_BITS // 32_768, 4_096), dtype=np.uint8)
    for part, bits in parts:
        out[part - 1] = np.frombuffer(bits, dtype=np.uint8)
    return out.ravel()


def prints_of(held: np.ndarray) -> np.ndarray:
    """A fingerprint of PRINTS times 64 bits, each part by its own mix of the shingles' hashes."""
    mixes = (_mixed(held + step) if step else held for step in STEP * np.arange(PRINTS, dtype=np.uint64))
    return np.array([majority((x[a : a + BLOCK] for a in range(0, len(x), BLOCK)), len(x)) for x in mixes], dtype=np.uint64)


def parities_of(held: np.ndarray) -> np.ndarray:
    """Whether an odd number of the shingles fall on each of PRINTS times 64 places; nothing for MANY_SHINGLES or more."""
    out = np.zeros(PRINTS, dtype=np.uint64)
    if len(held) < MANY_SHINGLES:
        np.bitwise_xor.at(out, (held >> np.uint64(6)).astype(np.int64) % PRINTS, np.uint64(1) << (held & np.uint64(63)))
    return out


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Hashes()
    for batch in batches:
        found = [shingles(t, known) for t in batch["text"]]
        told = {name: np.array([f(x) for x in found], dtype=np.uint64).reshape(-1, PRINTS).view(np.int64) for name, f in (("fp", prints_of), ("odd", parities_of))}
        yield pd.DataFrame({"no": batch["no"], "size": [len(x) for x in found], **{f"{name}{k}": x[:, k] for name, x in told.items() for k in range(PRINTS)}})


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Hashes()
    for batch in batches:
        for a in range(0, len(batch), 1_000):
            yield pd.DataFrame({"no": batch["no"].iloc[a : a + 1_000], "shingles": [shingles(t, known).view(np.int64) for t in batch["text"].iloc[a : a + 1_000]]})


def may_be_alike(sizes: np.ndarray, other_sizes: np.ndarray, prints: list[np.ndarray], others: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) may be at 0.8, by their numbers of shingles and their fingerprints: op6's chain on the first part, then the bits of all. Those of few shingles by the parities that follow the fingerprints, if they are given."""
    odd, other_odd, prints, others = prints[PRINTS:], others[PRINTS:], prints[:PRINTS], others[:PRINTS]
    a, b = sizes[i], other_sizes[j]
    low, high = np.minimum(a, b), np.maximum(a, b)
    may = np.flatnonzero(low * OF >= high * SHARED)
    few = low[may] < LEAST_SHINGLES
    near = within((prints[0][i[may]] ^ others[0][j[may]]).view(np.uint64), MAX_BITS)
    at = may[near & ~few]
    apart = sum(np.bitwise_count((p[i[at]] ^ o[j[at]]).view(np.uint64)).astype(np.int64) for p, o in zip(prints, others))
    out = np.zeros(len(a), dtype=bool)
    some = may[few]
    differ = sum((np.bitwise_count((p[i[some]] ^ o[j[some]]).view(np.uint64)).astype(np.int64) for p, o in zip(odd, other_odd)), np.zeros(len(some), dtype=np.int64))
    # What only one of two texts at 0.8 has is a ninth of what both have, counted twice.
    out[some[differ * (OF + SHARED) <= (a[some] + b[some]) * (OF - SHARED)]] = True
    out[at[apart <= ALL_BITS]] = True
    return out


def _pruned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        one, two = ([batch[f"{name}{k}_{c}"].to_numpy() for name in ("fp", "odd") for k in range(PRINTS)] for c in "ab")
        every = np.arange(len(batch))
        yield batch.loc[may_be_alike(batch["size_a"].to_numpy(), batch["size_b"].to_numpy(), one, two, every, every), ["a", "b", "size_b"]]


def _left(few: int, piece: int, group_bytes: int):
    """The texts of a key -> all pairs of different components that may be alike; of a key that leaves many of them, but is small enough for one task, its name alone."""

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, held, crowded = [], 0, []
            for key, under, no, label, size, *prints in zip(*(batch[c] for c in ("key", "under", *OWN))):
                most = few * len(no) if under <= piece and 8 * size.sum() <= group_bytes else np.inf
                own, n = [], 0
                for i, j in _in_blocks(len(no)):
                    differ = label[i] != label[j]
                    i, j = i[differ], j[differ]
                    may = may_be_alike(size, size, prints, prints, i, j)
                    a, b = no[i[may]], no[j[may]]
                    own.append(np.stack([np.maximum(a, b), np.minimum(a, b)]))
                    n += len(a)
                    if n > most:
                        break
                    if n >= ROWS and most == np.inf:
                        yield _pair_rows(own).assign(key=0)
                        own, n = [], 0
                if n > most:
                    crowded.append(key)
                else:
                    found, held = found + own, held + n
                if held >= ROWS:
                    yield _pair_rows(found).assign(key=0)
                    found, held = [], 0
            yield _pair_rows(found).assign(key=0)
            yield pd.DataFrame({"a": -1, "b": -1, "key": crowded})

    return left


def _left_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The texts of a crowded key with their shingles -> the pairs of different components that are alike. Texts that share several such keys are compared under the least."""
    for batch in batches:
        found = []
        for key, keys, held, no, label, size, *prints in zip(*(batch[c] for c in ("key", "keys", "shingles", *OWN))):
            other = [k[k < key] for k in keys]
            names, which = np.unique(np.concatenate(other), return_inverse=True)
            earlier = np.zeros((len(no), len(names)), dtype=np.float32)
            earlier[np.repeat(np.arange(len(no)), [len(k) for k in other]), which] = 1
            bits = _bitsets(list(held))
            for i, j in _in_blocks(len(no)):
                differ = label[i] != label[j]
                i, j = i[differ], j[differ]
                may = may_be_alike(size, size, prints, prints, i, j)
                i, j = i[may], j[may]
                step = max(1, (1 << 22) // max(1, bits.shape[1], earlier.shape[1]))
                for a in range(0, len(i), step):
                    x, y = i[a : a + step], j[a : a + step]
                    first = ~(earlier[x] * earlier[y]).any(axis=1)
                    x, y = x[first], y[first]
                    both = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
                    alike = both * OF >= SHARED * (size[x] + size[y] - both)
                    one, two = no[x[alike]], no[y[alike]]
                    found.append(np.stack([np.maximum(one, two), np.minimum(one, two)]))
        yield _pair_rows(found)


def _bitsets(held: list[np.ndarray]) -> np.ndarray:
    """Each text's shingles as a row of bits, for those that two of the texts have."""
    names, which, n = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    row = np.repeat(np.arange(len(held)), [len(x) for x in held])
    shared = n[which] > 1
    row, at = row[shared], place[which[shared]]
    bits = np.zeros((len(held), max(1, -(-int((n > 1).sum()) // 64))), dtype=np.uint64)
    np.bitwise_or.at(bits, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return bits


def _pair_rows(found: list[np.ndarray]) -> pd.DataFrame:
    a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=np.int64)
    return pd.DataFrame({"a": a, "b": b}).drop_duplicates()


@lru_cache(maxsize=256)
def _of_all(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _in_blocks(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n places, a bounded number of them at a time."""
    if n <= 64:
        yield _of_all(n)
        return
    step = max(1, (1 << 18) // n)
    for a in range(0, n, step):
        i, j = np.divmod(np.arange(min(step, n - a) * n), n)
        i += a
        yield i[j > i], j[j > i]


def node_of(text_col: str = "text") -> Column:
    """The name of a text: 128 bits of its hash."""
    return F.unhex(F.md5(text_of(text_col).cast("binary")))


def wordless(text_col: str = "text") -> Column:
    return F.translate(text_of(text_col), " \t\n\x0b\x0c\r", "") == ""


def _sent_if_small(df: DataFrame, bytes_each: int, most: int = SENT_BYTES) -> DataFrame:
    """``df`` (written), to be broadcast where its number of rows allows it."""
    return F.broadcast(df) if df.count() * bytes_each <= most else df


def _alike(candidates: DataFrame, texts: DataFrame, facts: DataFrame) -> DataFrame:
    """Of the pairs a > b those at 0.8 or more. Shingles are made of texts that a pair asks for alone."""
    slim = {c: facts.select(*(F.col(x).alias(c if x == "no" else f"{x}_{c}") for x in facts.columns)) for c in "ab"}
    pairs = candidates.distinct().join(slim["a"], "a").join(slim["b"], "b")
    pairs = written(pairs.mapInPandas(_pruned, "a long, b long, size_b long"), "candidates")
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("no")).distinct(), "asked")
    held = written(_shingled(texts, asked), "asked-shingles")
    whole = {c: held.select(F.col("no").alias(c), F.col("shingles").alias(f"shingles_{c}")) for c in "ab"}
    # Each pair takes shingles along. Where these come to several times those of the texts, pairs are put in parts, one after the other, so that disk follows the texts and not the pairs.
    moved, own = (df.agg(F.coalesce(F.sum(c) * 8, F.lit(0))).first()[0] for df, c in ((pairs, F.col("size_b")), (held, F.size("shingles"))))
    parts = -(-moved // max(PART_BYTES, own)) or 1
    if parts == 1:
        return _at_least(pairs, whole)
    of_part = lambda df, k: df.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == k)
    found = (written(_at_least(of_part(pairs, k), {"a": of_part(whole["a"], k), "b": whole["b"]}), "alike") for k in range(parts))
    return reduce(DataFrame.unionByName, found)


def _at_least(pairs: DataFrame, whole: dict[str, DataFrame]) -> DataFrame:
    """Of the pairs those at 0.8 or more, by their texts' shingles."""
    both = whole["b"].join(_sent_if_small(pairs.select("a", "b"), 32), "b").join(whole["a"], "a").select("a", "b", F.size("shingles_a").alias("n_a"), F.size("shingles_b").alias("n_b"), F.size(F.array_intersect("shingles_a", "shingles_b")).alias("both"))
    return both.where(F.col("both") * OF >= SHARED * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _shingled(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    return texts.join(_sent_if_small(wanted, 24), "no", "left_semi").mapInPandas(_whole, "no long, shingles array<long>")


def links(texts: DataFrame, frequent_from: int = FREQUENT, most_frequent: int = MOST_FREQUENT, few: int = FEW, rounds: int = ROUNDS, piece: int = PIECE, filtered: int = FILTERED) -> DataFrame:
    """``texts`` (no, text; each text once, none without words) -> links a > b between their numbers, pairs at 0.8 or more: enough of them to hold every component together."""
    ship_package(texts.sparkSession)
    context = texts.sparkSession.sparkContext
    # Any list gives the right answer; this one leaves little to do. Its length is bounded: the counts of counts tell where it ends.
    often = texts.select("text").mapInPandas(_several, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    often = written(often.where(F.col("n") >= frequent_from), "frequent-keys")
    least, listed = None, 0
    for n, keys in sorted(often.groupBy("n").agg(F.count("*")).collect(), reverse=True):
        if listed + keys > most_frequent:
            break
        least, listed = n, listed + keys
    most = often.where(F.col("n") >= least).select("key").collect() if least else []
    frequent = context.broadcast(np.sort(np.array([r.key for r in most], dtype=np.int64).view(np.uint64)))

    kind = "key long, no long, extra boolean"
    counted = texts.mapInPandas(_tokens(frequent, None), kind).groupBy("key").agg(F.count("*").alias("n"))
    shared = written(counted.where("n > 1").select("key"), "keys")
    # The filter leaves out most of what the join would; it can't take the join's place.
    bits = context.broadcast(key_filter(shared)) if shared.count() <= filtered else None
    members = written(texts.mapInPandas(_tokens(frequent, bits), kind).join(shared, "key", "left_semi"), "members")
    wanted = written(members.where("not extra").select("no").distinct(), "wanted")
    facts = texts.join(_sent_if_small(wanted, 24), "no", "left_semi").mapInPandas(_facts, "no long, size long, " + ", ".join(f"{c} long" for c in OWN[3:]))
    facts = written(facts, "facts")

    found, before = None, 0
    of_keys = members.where("not extra").select("key", "no")
    for turn in range(rounds + 2):
        at_keys, at_links = place(texts.sparkSession, "mixed-keys"), place(texts.sparkSession, "links")
        # What else a round writes goes with it.
        with scratch(texts.sparkSession):
            open_ = of_keys.withColumn("label", F.col("no"))
            if found is not None:
                labels = written(components(found), "labels").withColumnRenamed("a", "no")
                open_ = of_keys.join(labels, "no", "left").select("key", "no", F.coalesce("b", "no").alias("label"))
            by_label = open_.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("under"), F.sum(F.col("n") * F.col("n")).alias("settled"))
            mixed = by_label.withColumn("left", (F.col("under") * F.col("under") - F.col("settled")) / 2).where("left > 0")
            # A key of two texts is done after the first round.
            mixed = written(mixed.where("under > 2") if turn else mixed, "mixed-keys", at_keys)
            if mixed.isEmpty():
                break
            # The first round is for all keys, others for those that are too large to be compared as they are.
            large = mixed.where((F.col("under") > piece) & (F.col("left") > few * F.col("under")))
            left = large.agg(F.coalesce(F.sum("left"), F.lit(0))).first()[0]
            last = turn > rounds or turn > 0 and (left == 0 or turn > 1 and left > SLOW * before)
            before = left
            chosen = large if turn and not last else mixed
            open_ = written(open_.join(_sent_if_small(chosen.select("key", "under", "left"), 40), "key"), "open")
            new = written(_alike(_all_left(open_, members, texts, facts, few, piece) if last else _with_one(open_, turn), texts, facts), "links", at_links)
        found = new if found is None else found.unionByName(new)
        if last:
            break
        of_keys = of_keys.join(_sent_if_small(mixed.select("key"), 24), "key", "left_semi")
    return found if found is not None else members.select(F.col("no").alias("a"), F.col("no").alias("b")).limit(0)


def _with_one(open_: DataFrame, turn: int) -> DataFrame:
    """The texts of each key, each with the one that comes first in this round's order, where they are of different components.

    In the first round it is the text that shares most with others, by the sizes of its keys: of a group of copies the one that they were made from, or what is nearest to it.
    """
    h = F.xxhash64("no", F.lit(turn)).alias("h")
    if not turn:
        open_ = written(open_.join(open_.groupBy("no").agg((-F.sum("under")).alias("rank")), "no"), "ranked")
        h = F.struct("rank", h)
    first = open_.groupBy("key").agg(F.min(F.struct(h.alias("h"), "no", "label")).alias("first")).select("key", F.col("first.no").alias("one"), F.col("first.label").alias("one_label"))
    pairs = open_.join(first, "key").where("label <> one_label")
    return pairs.select(F.greatest("no", "one").alias("a"), F.least("no", "one").alias("b"))


def _all_left(open_: DataFrame, members: DataFrame, texts: DataFrame, facts: DataFrame, few: int, piece: int) -> DataFrame:
    """All pairs of different components under a key that may be alike.

    Where few such pairs are left they are handed on. Where more are, the shingles come to the key and only pairs that are alike are handed on, if the key is small enough for one task. Keys of more than ``piece`` texts are split by each second shingle.
    """
    n = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = open_.join(facts, "no")
    one = slim.where(F.col("under") <= piece).withColumn("second", F.lit(0).cast("long"))
    split = slim.where(F.col("under") > piece).join(members.select("no", F.col("key").alias("second")), "no")
    # Only a text of one shingle has no second: it is like others of one.
    split = split.where("second <> key or size = 1")

    def together(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
        # Groups are small but comparing them isn't: they are not gathered into few tasks by their bytes.
        groups = rows.repartition(n, *by).groupBy(*by).agg(F.collect_list(F.struct(*columns)).alias("m")).where("size(m) > 1")
        return groups.select(*by, *(F.col(f"m.{c}").alias(c) for c in columns))

    both = together(one.unionByName(split.select(*one.columns)), ["key", "second", "under"], OWN)
    left = written(both.mapInPandas(_left(few, piece, GROUP_BYTES), "a long, b long, key long"), "left")
    handed = left.where("a >= 0").select("a", "b")
    crowded = written(left.where("a < 0").select("key"), "crowded-keys")
    if crowded.isEmpty():
        return handed
    whole = one.join(_sent_if_small(crowded, 24), "key", "left_semi")
    keys = written(whole.groupBy("no").agg(F.collect_list("key").alias("keys")), "crowded-texts")
    held = keys.join(written(_shingled(texts, keys.select("no")), "crowded-shingles"), "no")
    full = together(whole.join(held, "no"), ["key"], [*OWN, "keys", "shingles"]).mapInPandas(_left_whole, "a long, b long")
    return handed.unionByName(full)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component of near copies, all columns: that with the least id.

    Equal texts are near copies. Texts without words (null, empty, blank) are one component. Rows without id come after all that have
    one; among equal ids the text's hash decides; rows that agree in id and text are interchangeable. No pair at 0.8 or more is left apart, but for one in 10^9 that the fingerprints' chain may prune; no pair
    below is ever joined by itself. An empty table gives an empty one. Texts of any length are compared whole. Columns of any name come through. Texts move where the list of first rows, or of the rows that are kept, is too
    large to be sent to all tasks.
    """
    node = F.when(wordless(text_col), F.lit(b"")).otherwise(node_of(text_col))
    rows = docs.select(*(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)), F.col(f"`{id_col}`").alias("id"), node.alias("node"))
    slim = rows.groupBy("id", "node").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "node", "n")).alias("first")
    firsts = written(slim.groupBy("node").agg(first).withColumn("no", F.monotonically_increasing_id()), "first-rows")

    told = firsts.where("node <> X''").select(F.col("node").alias("first_node"), F.col("first.id").alias("first_id"), F.col("first.n").alias("n"), "no")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), node.alias("node"), text_of(text_col).alias("text"))
    texts = texts.join(_sent_if_small(told, 64), (F.col("node") == F.col("first_node")) & F.col("id").eqNullSafe(F.col("first_id"))).select("no", "text", "n")
    # Rows that agree in id and text stand for one text.
    texts = texts.where("n = 1") if told.where("n > 1").isEmpty() else texts.where("n = 1").unionByName(texts.where("n > 1").dropDuplicates(["no"]))
    centre = components(links(texts.select("no", "text"), **how)).select(F.col("a").alias("no"), F.col("b").alias("centre"))
    groups = firsts.join(centre, "no", "left").groupBy(F.coalesce("centre", "no").alias("centre")).agg(F.min("first").alias("first"))
    kept = written(groups.select(F.col("first.id").alias("kept_id"), F.col("first.node").alias("kept_node"), F.col("first.n").alias("n")), "kept-rows")
    found = rows.join(_sent_if_small(kept, 64), (F.col("node") == F.col("kept_node")) & F.col("id").eqNullSafe(F.col("kept_id")))
    once = found.where("n = 1").unionByName(found.where("n > 1").dropDuplicates(["node"]))
    return once.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)))
