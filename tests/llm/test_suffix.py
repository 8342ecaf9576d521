import random
from collections import Counter

import numpy as np

from pagemill.llm import anchors, suffix

SCHEMA = "doc_id long, text string, kept string, n int, mh long"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mask = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mask[i : i + length] = True
        spans = sum(1 for i in range(len(d)) if mask[i] and (i == 0 or not mask[i - 1]))
        out.append((len(d), int(mask.sum()), spans, bytes(b for b, m in zip(d, mask) if not m)))
    return out


def corpus(seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdéfgh") for _ in range(r.randint(1, 8)))
    base = [" ".join(word() for _ in range(r.randint(1, 160))) for _ in range(30)]
    common = " ".join(word() for _ in range(60))
    texts = [None, "", "x", "a" * 3_000, "ab" * 900, common, common, *base, *base[:5]]
    for t in base[:10]:
        for _ in range(8):
            at = r.randrange(len(t) + 1)
            texts.append(t[:at] + r.choice(["", "é", "zz", common[: r.randrange(300)]]) + t[at + r.randint(0, 3) :])
    texts += [word() + common[r.randrange(20) : len(common) - r.randrange(20)] + word() for _ in range(40)]
    return texts


def test_equals_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in enumerate(texts)] + [(None, texts[5], None, None, None)], SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix.remove_repeats(df, 200, 32).collect()}
    want = brute(texts, 200)
    assert got.pop(None)[1] == 0
    assert got == dict(enumerate(want))


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(str(i * i) for i in range(200))
    df = spark.createDataFrame([(1, text, "", 1, 1)] * 2 + [(2, "short", "", 1, 1)], SCHEMA)
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix.remove_repeats(df).collect())
    assert got == [(1, len(text)), (1, len(text)), (2, 0)]
    assert suffix.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_cut_at_blocks_keep_every_window(monkeypatch):
    units = anchors.mix(np.arange(5_000, dtype=np.uint64) % np.uint64(700))
    whole = anchors.runs(units, 50, 8)
    monkeypatch.setattr(anchors, "BLOCK", 333)
    parts = anchors.runs(units, 50, 8)
    for at, n, _ in (whole, parts):
        assert at[0] == 0 and (at[1:] == at[:-1] + n[:-1]).all() and at[-1] + n[-1] == len(units) - 49
    spread = lambda x: np.repeat(x[2], x[1])
    assert (spread(whole) == spread(parts)).all()


def test_two_texts_under_one_id(spark):
    r = random.Random(3)
    one, two, three = (" ".join(str(r.randrange(10**9)) for _ in range(60)) for _ in range(3))
    df = spark.createDataFrame([(1, one, "", 1, 1), (1, two, "", 1, 1), (2, one, "", 1, 1), (2, two[:150] + three, "", 1, 1), (2, None, "", 1, 1)], SCHEMA).repartition(4)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix.remove_repeats(df).collect())
    assert got == sorted([(1, len(one), len(one)), (1, len(two), 0), (2, len(one), len(one)), (2, 150 + len(three), 0), (2, 0, 0)])


def test_names_are_those_of_pairs():
    raw = np.frombuffer(corpus()[10].encode() * 3, np.uint8)
    units = suffix.R.Units(words=False, length=200, grams=(32, 64, 128, 200), ordered=False)
    prefix = anchors.prefix_hash(suffix.R.BYTE_CODE[raw])
    for level, size in enumerate(units.grams):
        names = units.names(prefix, level)
        assert len(names) == len(raw) - size + 1
        seen = {}
        for i, x in enumerate(names.tolist()):
            assert seen.setdefault(x, raw[i : i + size].tobytes()) == raw[i : i + size].tobytes()
        assert len(seen) == len({raw[i : i + size].tobytes() for i in range(len(names))})
