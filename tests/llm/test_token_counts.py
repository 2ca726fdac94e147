import random

import pytest

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from reelyard.llm.token_counts import count_tokens, machine, token_counts  # noqa: E402
from tests.llm.cases import ODD, none, odd  # noqa: E402

MODEL = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_random_strings_and_chunks():
    draw, counts = random.Random(3), machine("piece_bpe_32k.model")
    for _ in range(800):
        text = "".join(draw.choice("aeioutnshrd   \n\t▁<s>/é日0123ing.,—​") for _ in range(draw.randint(0, 60)))
        want = len(MODEL.encode(text))
        assert count_tokens(text, counts) == want
        assert all(count_tokens(text, counts, chunk) == want for chunk in (2, 5, 16))
    assert [count_tokens(" " * n, counts) for n in range(80)] == [len(MODEL.encode(" " * n)) for n in range(80)]


def test_documents_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in token_counts(docs).collect():
        want = len(MODEL.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), want, want > 4096)
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_counts(odd(spark)).collect())
    assert got == sorted((r[0] or -1, len(MODEL.encode(r[1] or ""))) for r in ODD)
    assert token_counts(none(spark)).count() == 0
