import random

import pytest
import sentencepiece

from sievework.llm import queries, token_count


@pytest.fixture(scope="module")
def model():
    with open(queries.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_spliced_equals_whole(model):
    sp, joined = token_count.encoder(model)
    rng = random.Random(5)
    bits = ["the ", "x", " ", "  ", "\n", "é", "日本", "\U000130c0", "▁", "<s>", "ing", "0", "ab" * 50, "1234567", "    ", "\t", "ß-"]
    for n in range(60):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 400)))
        for chunk, overlap in ((40, 4), (100, 20), (333, 7)):
            assert token_count.spliced_count(sp, joined, text, chunk, overlap) == len(sp.encode(text)), (n, chunk, text)


@pytest.mark.parametrize("text", ["a" * 3000, " " * 3000, "▁" * 500, "ab" * 1500, "日" * 900, "\U000130c0" * 500])
def test_widens_where_nothing_aligns(model, text):
    sp, joined = token_count.encoder(model)
    assert token_count.spliced_count(sp, joined, text, 200, 10) == len(sp.encode(text))


class Counting:
    """The processor, adding up the bytes that it encodes."""

    def __init__(self, sp):
        self.sp, self.n_bytes = sp, 0

    def encode(self, text, **how):
        self.n_bytes += len(text.encode())
        return self.sp.encode(text, **how)

    def normalize(self, text):
        return self.sp.normalize(text)


@pytest.mark.parametrize("kind", ["dna", "letter", "blanks", "prose", "late"])
def test_work_stays_in_proportion(model, kind):
    """Texts without a stable place, and prose, at 800 k: not more than five times their bytes are encoded."""
    sp, joined = token_count.encoder(model)
    rng = random.Random(1)
    n = 800_000
    text = {"dna": "".join(rng.choices("ACGT", k=n)), "letter": "a" * n, "blanks": " " * n, "prose": "The quick brown fox, they say. " * (n // 31), "late": "a" * (n // 2) + " the end of it" * (n // 28)}[kind]
    counting = Counting(sp)
    assert token_count.spliced_count(counting, joined, text) == len(sp.encode(text))
    assert counting.n_bytes <= (1.2 if kind == "prose" else 5) * len(text)


def test_query_equals_library(spark, sf_dir, model):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op8_token_counts(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(sp.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_small_chunks_in_the_job(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = queries.tokenizer_path("piece_bpe_32k.model")
    a, b = (token_count.count_tokens(docs, path, chunk_bytes=c, overlap_bytes=16) for c in (500, 10**9))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_odd_rows(odd_docs, no_docs, model):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = token_count.count_tokens(odd_docs, path).collect()
    want = [(r.doc_id, len(sp.encode(r.text or ""))) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(want, key=repr)
    assert token_count.count_tokens(no_docs, path).count() == 0
