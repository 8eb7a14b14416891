"""Properties of the helpers that run inside tasks, on generated input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import decontaminate, line_dedup, mph, queries, sharding, simhash_dedup, token_count

from .test_simhash_dedup import brute_fingerprint

TEXT = st.text(st.sampled_from(list("aAbZé日 \t\n\x0b\x0c\r\x1c\x85 <s>[]/▁1.-") + ["\U000130c0"]), max_size=120)
FEW = settings(max_examples=60, deadline=None)


@FEW
@given(TEXT)
def test_fingerprint(text):
    assert simhash_dedup.fingerprint(text) == brute_fingerprint(text)


@FEW
@given(TEXT, st.integers(8, 60), st.integers(1, 12))
def test_spliced_count(text, chunk, overlap):
    with open(queries.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        sp, joined = token_count.encoder(f.read())
    assert token_count.spliced_count(sp, joined, text, max(chunk, overlap + 8), overlap) == len(sp.encode(text))


@FEW
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=300))
def test_minimal_perfect_hash(keys):
    h = np.array(sorted(keys), dtype=np.uint64).reshape(-1, 2)
    built = mph.build(h[:, 0], h[:, 1], np.arange(1, len(h) + 1))
    assert mph.Index(**built).lookup(h[:, 0], h[:, 1]).tolist() == list(range(1, len(h) + 1))
    assert len(built["fingerprints"]) == 8 * len(h)


@FEW
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(words):
    assert decontaminate.suffix_array(np.array(words, dtype=np.int64)).tolist() == sorted(range(len(words)), key=lambda i: words[i:])


@FEW
@given(st.lists(st.integers(1, 10**6), max_size=80), st.integers(1, 9))
def test_differencing(sizes, parts):
    part = sharding.differencing(dict(enumerate(sizes)), parts)
    assert set(part) == set(range(len(sizes))) and set(part.values()) <= set(range(parts))
    loads = [sum(s for i, s in enumerate(sizes) if part[i] == p) for p in range(parts)]
    # No part is further from another than the largest indivisible group.
    assert max(loads, default=0) - min(loads, default=0) <= max(sizes, default=0)


@FEW
@given(TEXT)
def test_line_keys(text):
    for line in text.split("\n"):
        key = line_dedup.line_key(line.encode()).decode()
        assert key == "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
