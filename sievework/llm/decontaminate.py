"""Benchmark decontamination with suffix arrays of the training texts.

Documents are cut into shards of a bounded number of words; each shard gets a suffix array over its words,
with a separator of its own after every document. Every suffix of every benchmark item is searched in every shard by
binary search, one word deeper at a time: where the interval of the array runs empty is the
longest verbatim match, and the interval at the depth of a window holds all places where the window occurs.
Documents stay where they are; only the benchmark travels, in packed blocks of bounded bytes. A shard's suffix array is built once and meets the
blocks one after the other, so a task holds one shard, the packed blocks and one of them unpacked.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import fresh, ship_package, text_of

WINDOW = 10
#: Words of a shard (a longer document is a shard alone); bytes of a packed block of the benchmark, and of all blocks that are sent out for one search.
SHARD_WORDS, BLOCK_BYTES, MOST_BYTES = 1 << 19, 4_000_000, 128_000_000
#: Bytes that a packed block takes besides words and names, and for each piece; bytes of a word that are usual.
FRAME_BYTES, PIECE_BYTES, WORD_BYTES = 400, 20, 8
#: Fixed pattern: in UTF-8 no other byte belongs to a word.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOUND = "n_words long, n_hit long, items array<string>, starts array<long>, ends array<long>, longest long, longest_at long, longest_item string"


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


class Vocabulary(dict):
    """Numbers words in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling over the suffixes that are still tied."""
    n = len(words)
    if n < 2:
        return np.arange(n)
    key = words * (int(words.max()) + 2)
    key[:-1] += words[1:] + 1
    sa = np.argsort(key)
    key = key[sa]
    new = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = 2
    while True:
        tied = np.flatnonzero(~new | ~np.r_[new[1:], True])
        if not len(tied):
            return sa
        at = sa[tied]
        then = np.minimum(at + depth, n)
        key = rank[at] * (n + 2) + np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
        order = np.argsort(key)
        key, at = key[order], at[order]
        sa[tied] = at
        new[tied] = fresh = np.r_[True, key[1:] != key[:-1]]
        rank[at] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        depth *= 2


def _bound(padded: np.ndarray, sa: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
    """For each interval the first place whose word at ``depth`` is not below ``word``."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        below = padded[sa[np.minimum(mid, len(sa) - 1)] + depth] < word
        low = np.where(open_ & below, mid + 1, low)
        high = np.where(open_ & ~below, mid, high)
    return low


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the intervals, and the interval of each."""
    sizes = high - low
    owner = np.repeat(np.arange(len(low)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner], owner


class Block:
    """Pieces of the benchmark as numbered words. pieces: (item's id, words, whether it is the whole item)."""

    def __init__(self, pieces: list[tuple[str, list[bytes], bool]], window: int):
        vocabulary = Vocabulary()
        words = np.fromiter((vocabulary[w] for _, ws, _ in pieces for w in ws), dtype=np.int32)
        self._made([i for i, _, _ in pieces], words, np.array([len(ws) for _, ws, _ in pieces], dtype=np.int32), np.array([whole for _, _, whole in pieces], dtype=bool), list(vocabulary), window)

    def _made(self, ids: list[str], words: np.ndarray, sizes: np.ndarray, whole: np.ndarray, vocabulary: list[bytes], window: int) -> None:
        self.ids, self.words, self.sizes, self.whole, self.vocabulary, self.window = ids, words, sizes, whole, vocabulary, window
        self.item = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.room = np.cumsum(sizes, dtype=np.int64)[self.item] - np.arange(len(words))
        # The depth at which a suffix is a window; 0: the end of a longer item, not a window.
        depth = np.where(whole, np.minimum(sizes, window), window)[self.item]
        self.depth = np.where(self.room >= depth, depth, 0)

    def packed(self) -> bytes:
        """What is sent: 4 bytes a word, and each different word once."""
        return pickle.dumps((self.ids, self.words.tobytes(), self.sizes.tobytes(), self.whole.tobytes(), b" ".join(self.vocabulary), self.window))

    @classmethod
    def unpacked(cls, data: bytes) -> Block:
        ids, words, sizes, whole, vocabulary, window = pickle.loads(data)
        block = cls.__new__(cls)
        block._made(ids, np.frombuffer(words, dtype=np.int32), np.frombuffer(sizes, dtype=np.int32), np.frombuffer(whole, dtype=bool), vocabulary.split(), window)
        return block


def blocks_of(items: Iterable[tuple[str, str]], window: int, block_bytes: int) -> Iterator[bytes]:
    """(id, text) -> packed blocks of ``block_bytes`` at most, or of one piece where that is larger.

    An item that would fill more than half a block is cut into pieces that overlap by half, at least by a window less a word: each of its windows lies whole in one of them.
    """
    longest = max(4 * window, block_bytes // (2 * (WORD_BYTES + 4)))
    pieces, known, size = [], set(), FRAME_BYTES
    for i, text in items:
        words = words_of(text)
        for a in range(0, max(1, len(words) - longest // 2), longest // 2) if len(words) > longest else [0] if words else []:
            piece = words[a : a + longest]
            more = 4 * len(piece) + len(i.encode()) + PIECE_BYTES
            new = set(piece) - known
            if pieces and size + more + sum(len(w) + 1 for w in new) > block_bytes:
                yield Block(pieces, window).packed()
                pieces, known, size, new = [], set(), FRAME_BYTES, set(piece)
            pieces.append((i, piece, len(words) <= longest))
            known |= new
            size += more + sum(len(w) + 1 for w in new)
    if pieces:
        yield Block(pieces, window).packed()


def search_shard(words: np.ndarray, sa: np.ndarray, vocabulary: dict, doc_of: np.ndarray, block: Block):
    """(start, end) of window occurrences, (document, item) pairs, and (document, length, place, item) of long matches, the first place and item of each length."""
    known = np.array([vocabulary.get(w, -1) for w in block.vocabulary], dtype=np.int64)
    query = known[block.words]
    padded = np.concatenate([words, np.full(int(block.room.max()) + 1, -2, dtype=np.int64)])
    active = np.flatnonzero(query >= 0)
    low, high = np.zeros(len(active), dtype=np.int64), np.full(len(active), len(sa), dtype=np.int64)
    spans, pairs, long = [], [], []
    depth = 0
    while len(active):
        word = query[active + depth]
        low, high = _bound(padded, sa, low, high, depth, word), _bound(padded, sa, low, high, depth, word + 1)
        depth += 1
        going = low < high
        active, low, high = active[going], low[going], high[going]
        window = block.depth[active]
        if (full := window == depth).any():
            # Suffixes that begin alike share an interval: its places are listed once.
            low_once, first, which = np.unique(low[full], return_index=True, return_inverse=True)
            places, owner = _ranges(low_once, high[full][first])
            spans.append((sa[places], sa[places] + depth))
            hits = np.unique(np.stack([owner, doc_of[sa[places]]], axis=1), axis=0)
            holders = np.unique(np.stack([which, block.item[active[full]]], axis=1), axis=0)
            begin = np.searchsorted(holders[:, 0], hits[:, 0])
            stop = np.searchsorted(holders[:, 0], hits[:, 0], side="right")
            at, of = _ranges(begin, stop)
            pairs.append(np.unique(np.stack([hits[of, 1], holders[at, 1]], axis=1), axis=0))
        if (deep := (window > 0) & (window <= depth)).any():
            low_once, first = np.unique(low[deep], return_index=True)
            places, owner = _ranges(low_once, high[deep][first])
            by_place = np.argsort(sa[places])
            docs, one = np.unique(doc_of[sa[places]][by_place], return_index=True)
            one = by_place[one]
            long.append((docs, np.full(len(docs), depth), sa[places[one]], block.item[active[deep][first][owner[one]]]))
        more = block.room[active] > depth
        active, low, high = active[more], low[more], high[more]
        known_next = query[active + depth] >= 0
        active, low, high = active[known_next], low[known_next], high[known_next]
    return spans, pairs, long


def search_texts(texts: list[str], blocks: Iterable[Block], shard_words: int = SHARD_WORDS) -> list[tuple]:
    """A tuple of the fields of FOUND for each text. ``blocks`` is gone through once for each shard."""
    found, at = [], 0
    while at < len(texts):
        vocabulary, parts, sizes = Vocabulary(), [], []
        total = 0
        while at < len(texts) and (total < shard_words or not sizes):
            words = words_of(texts[at])
            parts.append(np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int64, count=len(words)))
            sizes.append(len(words))
            total += len(words)
            at += 1
        starts = np.cumsum([0] + [s + 1 for s in sizes])
        words = np.empty(starts[-1], dtype=np.int64)
        for n, p in enumerate(parts):
            words[starts[n] : starts[n] + len(p)] = p
            words[starts[n + 1] - 1] = len(vocabulary) + n
        doc_of = np.repeat(np.arange(len(sizes)), np.array(sizes) + 1)

        sa, step = suffix_array(words), np.zeros(len(words) + 1, dtype=np.int64)
        items, longest = [set() for _ in sizes], [(0, 0, "")] * len(sizes)
        for block in blocks:
            spans, pairs, long = search_shard(words, sa, vocabulary, doc_of, block) if len(block.words) else ([], [], [])
            for a, b in spans:
                step[a] += 1  # windows of one length never share a place
                step[b] -= 1
            for d, i in np.concatenate(pairs).tolist() if pairs else []:
                items[d].add(block.ids[i])
            for docs, lengths, places, of in long:
                for d, n, p, i in zip(docs.tolist(), lengths.tolist(), places.tolist(), of.tolist()):
                    # The longest; of these the first place, then the least item.
                    if n > longest[d][0] or n == longest[d][0] and (p, block.ids[i]) < longest[d][1:]:
                        longest[d] = (n, p, block.ids[i])
        edge = np.diff(np.r_[False, np.cumsum(step[:-1]) > 0, False].astype(np.int8))
        out = [[s, 0, sorted(held), [], [], n, p - int(starts[d]) if n else None, i if n else None] for d, (s, held, (n, p, i)) in enumerate(zip(sizes, items, longest))]
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            row = out[doc_of[a]]
            row[1] += b - a
            row[3].append(a - int(starts[doc_of[a]]))
            row[4].append(b - int(starts[doc_of[a]]))
        found += map(tuple, out)
    return found


class Sent:
    """Packed blocks that were broadcast together; one at a time is unpacked."""

    def __init__(self, shared):
        self.shared = shared

    def __iter__(self) -> Iterator[Block]:
        return map(Block.unpacked, self.shared.value)


def _searcher(sent: Sent, shard_words: int):
    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(search_texts(list(texts), sent, shard_words), columns=[x.split()[0] for x in FOUND.split(", ")])

    return search


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """id and text of the items; equal ones are one."""
    return benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("id"), text_of(item_text_col).alias("text")).distinct()


def _parts(items: DataFrame, window: int, block_bytes: int, most_bytes: int) -> Iterator[list[bytes]]:
    """The blocks of the benchmark in lists of ``most_bytes`` at most, one at a time on the driver. Items come to it a partition at a time."""
    part, size = [], 0
    rows = ((r.id, r.text) for r in items.orderBy("id", F.md5(F.col("text").cast("binary"))).toLocalIterator())
    for block in blocks_of(rows, window, block_bytes):
        if part and size + len(block) > most_bytes:
            yield part
            part, size = [], 0
        part.append(block)
        size += len(block)
    yield part


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, out: str = "found", shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs``, all columns, with a struct ``out`` of the fields of FOUND.

    n_hit counts the document's words inside any occurrence of a window (``window`` consecutive words of an item, or a shorter
    item whole); starts and ends are the merged stretches of such words, items the ids (as strings, sorted) of
    items with such a window; longest, longest_at and longest_item are the longest verbatim match that holds a window and
    where in the document it is (ties: the first place, then the least item). Null texts and texts without words match nothing, nor do such items. A null item_id counts as the
    id "". Items with equal ids count once, and items that agree in id and text are one. An empty table gives an empty one. Texts of any length are searched whole: a longer document is a shard alone, and an item longer than half
    a block is searched in pieces that overlap by half, so that its windows are all found; only a longest match of more than a quarter of a block may be reported shorter. A column of the input named like ``out`` is replaced.
    A benchmark of more than ``most_bytes``, as it is packed, is an error: it would be too much to send to every task; ``decontaminated`` takes one of any size.
    """
    ship_package(docs.sparkSession)
    parts = _parts(_items(benchmark, item_col, item_text_col), window, block_bytes, most_bytes)
    first = next(parts)
    if next(parts, None) is not None:
        raise ValueError(f"a benchmark of more than {most_bytes} bytes, as it is packed")
    return _searched(docs, first, text_col, out, shard_words)


def _searched(docs: DataFrame, blocks: list[bytes], text_col: str, out: str, shard_words: int) -> DataFrame:
    return docs.withColumn(out, _searcher(Sent(docs.sparkSession.sparkContext.broadcast(blocks)), shard_words)(text_of(text_col)))


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; same columns. A benchmark of more than ``most_bytes``, as it is packed, is searched in parts."""
    ship_package(docs.sparkSession)
    found = fresh(docs, "found")
    for part in _parts(_items(benchmark, item_col, item_text_col), window, block_bytes, most_bytes):
        docs = _searched(docs, part, text_col, found, shard_words).where(F.col(f"`{found}`.n_hit") == 0).drop(found)
    return docs
