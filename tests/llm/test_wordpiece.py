import random

import public_tokenizers

from pagemill.llm import wordpiece

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, key string, n_words int"


def greedy(initial, inner, word, longest=10**9):
    at, made, pieces = 0, 0, initial
    while at < len(word):
        end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, made, pieces = end, made + 1, inner
    return made


def test_small_vocabularies_equal_naive_greedy():
    r = random.Random(6)
    for _ in range(200):
        make = lambda: {bytes(r.choice(b"abc") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 14))}
        initial, inner = make(), make()
        counter = wordpiece.PieceCounter(initial, inner)
        for _ in range(60):
            word = bytes(r.choice(b"abcd") for _ in range(r.randint(1, 14)))
            assert counter.count(word) == greedy(initial, inner, word), (initial, inner, word)


def test_token_counts_equal_naive_greedy(spark):
    initial, inner = map(set, wordpiece.byte_level_pieces(PATH))
    begun = {x[0] for x in initial if x}
    initial |= {x for x in inner if len(x) == 1 and x[0] not in begun}
    longest = max(map(len, initial | inner))
    r = random.Random(7)
    texts = [None, "", " \n", "Hello wonderful, world", "a" * 5_000, "x " * 20_000] + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(192, 0x250), 0x4E2D, 10, 32])) for _ in range(r.randint(1, 90))) for _ in range(120)]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)]
    got = wordpiece.token_counts(spark.createDataFrame(rows + rows[3:4] + [(None, None, None, None)], SCHEMA), PATH).collect()
    assert len(got) == len(rows) + 2
    for row in got:
        words = ((texts[row["doc_id"]] if row["doc_id"] is not None else "") or "").encode().split()
        assert (row["n_words"], row["n_pieces"]) == (len(words), sum(greedy(initial, inner, w, longest) for w in words))
    assert wordpiece.token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0
