import random
import re

import pytest

from pagemill.llm import substring_index as S

SCHEMA = "doc_id long, text string, kept string, n_words int, mh long"


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def brute(docs, length):
    """docs: (id, text) pairs; ids may repeat."""
    least = {}
    for d, t in docs:
        w = words_of(t)
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            least[k] = min(least.get(k, d), d)
    out = {}
    for d, t in docs:
        w = words_of(t)
        gone = set()
        for i in range(len(w) - length + 1):
            if least[tuple(w[i : i + length])] < d:
                gone.update(range(i, i + length))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 5)))
    gap = lambda: r.choice([" ", " ", "\n", " \t"])
    base = [[word() for _ in range(r.randint(1, 260))] for _ in range(30)]
    common = [word() for _ in range(80)]
    texts = [None, "", "one", "go " * 9_000, "go " * 70]
    for w in base + base[:6]:
        texts.append("".join(x + gap() for x in w))
    for w in base[:12]:
        for _ in range(6):
            v = list(w)
            at = r.randrange(len(v) + 1)
            v[at : at + r.randint(0, 2)] = r.choice([[], [word()], common[r.randrange(30) :]])
            texts.append("".join(x + gap() for x in v))
    texts += ["".join(x + gap() for x in [word(), *common[r.randrange(10) : 80 - r.randrange(10)], word()]) for _ in range(40)]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("batches", "bound"), [(1, 4096), (3, 4096), (4, 3)])
def test_equals_brute_force(spark, batches, bound):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in docs] + [(docs[9][0], docs[9][1], "k", 1, 2), (None, docs[7][1], None, None, None)], SCHEMA).repartition(3)
    got = S.remove_repeats(df, batches, 1, S.word_units(50, 8, bound)).collect()
    assert len(got) == len(docs) + 2
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got}
    assert found.pop(None)[1] == 0
    assert found == brute(docs, 50)


def test_batch_by_batch_with_compaction(spark, tmp_path):
    """The index is closed and opened again from its folder before every batch."""
    docs = corpus()
    folder = str(tmp_path / "index")
    index = S.FingerprintIndex(spark, S.word_units(), fanout=2, folder=folder)
    found, seen = {}, []
    for at in range(0, len(docs), 40):
        some = docs[at : at + 40]
        batch = S.keyed(spark.createDataFrame([(d, t, "", 0, 0) for d, t in some], SCHEMA))
        library = S.keyed(spark.createDataFrame([(d, t, "", 0, 0) for d, t in seen], SCHEMA))
        if at:
            index.close()
            index = S.FingerprintIndex.open(spark.newSession(), folder, fanout=2)
        found |= {r["key"]: (r["n_units"], r["n_removed"], bytes(r["kept"]).decode()) for r in S.add_batch(index, batch, library).collect()}
        assert len(index.runs) <= 2 and index.last == some[-1][0]
        seen += some
    with pytest.raises(ValueError):
        S.add_batch(index, batch, library)
    assert S.add_batch(index, batch.where("key < 0")).count() == 0
    index.remove()
    with pytest.raises(FileNotFoundError):
        S.FingerprintIndex.open(spark, folder)
    assert found == brute(docs, 50)


def test_two_texts_under_one_id(spark):
    r = random.Random(3)
    one, two, three = (" ".join(str(r.randrange(10**9)) for _ in range(80)) for _ in range(3))
    rows = [(1, one), (1, two), (2, one), (2, three), (3, two + " " + three)]
    df = spark.createDataFrame([(d, t, "", 1, 1) for d, t in rows], SCHEMA).repartition(3)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in S.remove_repeats(df).collect())
    assert got == [(1, 80, 0), (1, 80, 0), (2, 80, 0), (2, 80, 80), (3, 160, 160)]


def test_windows_of_one_hash_are_compared_by_bytes(monkeypatch):
    """With a hash that takes all windows for equal, only equal bytes count."""
    import numpy as np
    import pyarrow as pa

    units = S.word_units(3, 2)
    segs = [b"a b c d", b"x b c d", b"b c d"]
    table = pa.table([pa.array(c) for c in ([7, 7, 7], [1, 2, 3], [0, 0, 0], [0, 0, 0], np.array([2, 2, 1], np.int32), [1, 2, 3], [True] * 3, [1, 1, 1], segs)], list("abcdefghi"))
    want = [(2, 1, 1), (3, 0, 1)]
    plain = S.R._compare(units, table).to_pydict()
    monkeypatch.setattr(S.R.A, "span_hash", lambda prefix, a, z: np.zeros(len(a), np.uint64))
    blind = S.R._compare(units, table).to_pydict()
    assert list(zip(plain["key"], plain["at"], plain["n"])) == want == list(zip(blind["key"], blind["at"], blind["n"]))


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
