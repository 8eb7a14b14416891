"""Token counts by overlap resynchronisation.

A text longer than ``chunk_bytes`` is encoded as overlapping chunks with byte offsets. Two neighbouring
chunks are spliced at a boundary that both encodings have and that is *proven* stable: the two characters
around it stand side by side in no piece of the vocabulary. A merge only ever builds pieces of the
vocabulary, so none can reach across such a place, whatever text stands further off; what is counted left
and right of it is what one pass over the whole text would give. An overlap is made as wide as the last such place needs, and
doubled where the encodings still don't agree. Where a chunk has no such place at all it grows, by twice as much each time, so that what is
encoded stays in proportion to the text. Shorter texts are encoded in one go.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import ship_package, text_of

#: UTF-8 bytes of a chunk, of the first overlap tried, and of the texts handed to the encoder at once.
CHUNK_BYTES, OVERLAP_BYTES, BATCH_BYTES = 32_768, 512, 1_000_000
SPACE = "▁"


@lru_cache(maxsize=2)
def encoder(model: bytes):
    """The processor for a serialised model, and the pairs of characters that stand side by side in any piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    joined = {p[i : i + 2] for n in range(sp.get_piece_size()) if not (sp.is_control(n) or sp.is_byte(n) or sp.is_unknown(n)) for p in [sp.id_to_piece(n)] for i in range(len(p) - 1)}
    return sp, joined


def _char_start(data: bytes, at: int) -> int:
    """The start of the character that holds byte ``at``."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _proven(data: bytes, at: int, joined: set[str]) -> bool:
    left = data[_char_start(data, at - 1) : at].decode()
    right = data[at : at + 4].decode(errors="ignore")[:1]
    return (left + right).replace(" ", SPACE) not in joined


def spliced_count(sp, joined: set[str], text: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> int:
    """The tokens of one text, encoded in overlapping chunks."""
    if sp.normalize(text) != SPACE + text.replace(" ", SPACE):  # offsets would be those of another text
        return len(sp.encode(text, return_type="numpy", num_threads=1))
    data = text.encode()

    def starts(a: int, b: int) -> list[int]:
        return [a + p.begin for p in sp.encode(data[a:b].decode(), return_type="proto", num_threads=1).pieces]

    def last_place(low: int, high: int) -> int | None:
        """The last proven place between ``low`` and ``high``, without them."""
        at = high
        while (at := _char_start(data, at - 1)) > low:
            if _proven(data, at, joined):
                return at
        return None

    total, cut, a, b, grow = 0, 0, 0, _char_start(data, min(chunk, len(data))), chunk
    here, searched = starts(a, b), cut
    while b < len(data):
        place, splice = last_place(max(cut, searched), b), None
        if place is not None:
            width, own = max(overlap, 2 * (b - place)), set(here)
            while splice is None:
                c = max(cut, _char_start(data, max(0, b - width)))
                d = _char_start(data, min(c + max(chunk, 2 * width), len(data)))
                there = starts(c, d)
                splice = next((p for p in reversed(there) if max(c, cut) < p < b and p in own and _proven(data, p, joined)), None)
                if c == cut:
                    break
                width *= 2
        if splice is None:  # nothing in the whole chunk: let it grow
            searched = b - 1
            b, grow = _char_start(data, min(b + grow, len(data))), 2 * grow
            here = starts(a, b)
        else:
            total += sum(cut <= p < splice for p in here)
            cut, a, b, here, grow, searched = splice, c, d, there, chunk, splice
    return total + sum(p >= cut for p in here)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty: no bytes, no tokens. Ids may be null or repeated; they are only carried, so repeated rows all stay and there are no ties. Texts of any length are counted whole, the longer ones in
    chunks; one that the model's normaliser changes is encoded in one go. An empty table gives an empty result.
    Other columns are not read, so their names can't clash. The model file is read once on the driver (its
    size is fixed) and travels with the task.
    """
    ship_package(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp, joined = encoder(model.value)
        for texts in batches:
            counts, few, size = [0] * len(texts), [], 0

            def flush() -> None:
                for i, ids in zip(few, sp.encode([texts.iat[i] for i in few], return_type="numpy", num_threads=1) if few else []):
                    counts[i] = len(ids)
                few.clear()

            for i, t in enumerate(texts):
                if len(t) > chunk_bytes or len(t) * 4 > chunk_bytes and len(t.encode()) > chunk_bytes:
                    counts[i] = spliced_count(sp, joined, t, chunk_bytes, overlap_bytes)
                    continue
                few.append(i)
                size += len(t)
                if size >= BATCH_BYTES:
                    flush()
                    size = 0
            flush()
            yield pd.Series(counts, dtype="int64")

    text = text_of(text_col)
    counted = docs.select(F.col(f"`{id_col}`").alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
