import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagemill.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, n_tokens int, decoded string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(1)
    letters = "aabcinthe<|>/w w\t\x1c　\x85ΑΣς sİéßñ́ǅ9²½'\n!?#$startofx"
    fixed = ["", " ", "\n\t", "Hello, World! it's 2024", "a" * 20_000, "ha" * 9_000, "the " * 9_000, "0" * 500, "<|endoftext|>Foo <|startoftext|>", "<|endoftext|", "ÀÉ é", "ΣΑΣ", "'s't"]
    return fixed + ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(600)]


def test_codec_equals_library(library):
    codec = bpe.WordBpe(PATH)
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:60]
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_backtracking_equals_merging():
    """Against merges done one by one, on symbol strings that force backing up."""
    codec, r = bpe.WordBpe(PATH), random.Random(4)

    def merged(symbols):
        first = {codec.length[i] == 1 and i: i for i in range(512)}
        assert first
        tokens = [codec.encode_symbols(c)[0] for c in symbols]
        while True:
            ranked = [(codec.merged[p], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in codec.merged]
            if not ranked:
                return tokens
            rank, i = min(ranked)
            tokens[i : i + 2] = [rank]

    for _ in range(1500):
        raw = bytes(r.choice(b"aaeinorsthl") for _ in range(r.randint(1, 24)))
        symbols = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        assert codec.encode_symbols(symbols) == merged(symbols)


def test_round_trip_digests(spark, library):
    some = texts()[:200]
    rows = [(i, t, "x", 0, None) for i, t in enumerate(some)]
    df = spark.createDataFrame(rows + rows[:3] + [(None, None, None, None, None), (7_000, None, "", 1, "")], SCHEMA)
    got = bpe.round_trip_digests(df, PATH).collect()
    assert len(got) == len(some) + 5
    for row in got:
        text = some[row["doc_id"]] if row["doc_id"] is not None and row["doc_id"] < 7_000 else ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_and_decode_apart(spark, library):
    df = spark.createDataFrame([(1, "Hello, it's <|endoftext|> 2024", "", 0, ""), (2, None, "", 0, "")], SCHEMA)
    one = {r["doc_id"]: r for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    both = {r["doc_id"]: r for r in bpe.round_trip(df, PATH).collect()}
    assert one == both and one[2]["decoded"] == "" and bytes(one[1]["ids"]) == np.array(library.encode("Hello, it's <|endoftext|> 2024", add_special_tokens=False).ids, "<u4").tobytes()


def test_empty_table(spark):
    assert bpe.round_trip_digests(spark.createDataFrame([], SCHEMA), PATH).count() == 0
