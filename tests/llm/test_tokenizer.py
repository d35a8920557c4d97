import base64
import random

import pytest

from strandlake.llm.tokenizer import VOCABULARY, ByteBPE, decoded_texts, loaded, token_counts, token_ids

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def both():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ByteBPE(), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids(both):
    own, other = both
    rng = random.Random(0)
    bits = ["'", "s", "re", "ve", "ll", "d", "'t", "'re", " ", "  ", "\n", "\r\n", "\t", "\xa0", "a", "Zé", "漢字", "1", "½", "!", "--", "\0", "😀", "don't", "\u0301", "<|endoftext|>", "W", "="]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(16))) for _ in range(1500)]
    texts += ["", " ", "\n\n", "a" * 20_000, "ab" * 9_000, " " * 5_000, "é" * 3_000, base64.b64encode(bytes(range(256)) * 20).decode()]
    ids, n = own.encode_block(texts)
    at = 0
    for t, k in zip(texts, n):
        want = other.encode_ordinary(t)
        assert ids[at : at + k].tolist() == want == own.encode(t), repr(t[:60])
        assert own.decode(want) == t
        at += k
    assert own.encode_block(texts, counts_only=True)[1].tolist() == n.tolist()


def test_store_starts_anew(both, monkeypatch):
    own, other = both
    monkeypatch.setattr("strandlake.llm.tokenizer.KEPT_PIECES", 3)
    for t in ("one two three four five six", "seven eight nine one two"):
        assert own.encode(t) == other.encode_ordinary(t)


def test_rows(spark, both):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "  ", "x"), (1, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in token_ids(df).collect())
    assert got == sorted((i, both[1].encode_ordinary(t or "")) for i, t, _ in rows)
    assert {(r["doc_id"], r["n_tokens"]) for r in token_counts(df).collect()} == {(i, len(both[1].encode_ordinary(t or ""))) for i, t, _ in rows}
    assert token_ids(df.where("false")).collect() == []


def test_long_texts_in_parts_give_the_same():
    bpe = loaded(VOCABULARY)
    rng = random.Random(4)
    for block in (1, 7, 40):
        for _ in range(60):
            text = "".join(rng.choice(["we've ", "don't", " x", "\n\n  a", "12", "'s", " '", "é", "　", ".", "  ", "it's 5"]) for _ in range(60))
            assert bpe.encode_long(text, block=block)[0].tolist() == bpe.encode(text)
            assert bpe.encode_long(text, True, block)[1].tolist() == [len(bpe.encode(text))]


def test_decoding(spark):
    texts = ["", None, "  ", "a\tb", "naïve – ☃ 𝒳", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in decoded_texts(token_ids(df)).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
