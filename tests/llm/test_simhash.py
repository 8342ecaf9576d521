import random

import numpy as np
import xxhash

from pagemill.llm import simhash

SCHEMA = "doc_id long, text string, component string, fp string, n_tokens int"


def brute_fingerprint(text, shingle):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, limit):
    parent = {d: d for d in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = sorted(fps.items())
    for i, (d, f) in enumerate(items):
        for e, g in items[i + 1 :]:
            if (f ^ g).bit_count() <= limit:
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: root(d) for d in fps}


def corpus():
    r = random.Random(5)
    words = ["Alpha", "beta", "gamma", "Été", "delta", "eps", "zeta", "eta", "x\x1cy", "theta"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(5, 120))) for _ in range(25)]
    texts = [None, "", " \t\n", "one", "one two", "One two", "x" * 50_000, "a " * 30_000, *base, *base[:4]]
    for t in base[:12]:
        for _ in range(6):
            w = t.split()
            w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
    return texts


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    rows = [(i, t, "x", None, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[5:7] + [(None, "one two", "x", None, None)], SCHEMA)
    for tile in (20_000, 5):
        got = simhash.near_duplicates(df, shingle=4, limit=4, tile=tile).collect()
        fps = {i: brute_fingerprint(t, 4) for i, t in enumerate(texts)}
        classes = brute_components(fps, 4)
        assert len(got) == len(texts) + 3
        for row in got:
            if row["doc_id"] is None:
                assert row["component"] is None
                continue
            assert row["fp"] % (1 << 64) == fps[row["doc_id"]]
            assert row["component"] == classes[row["doc_id"]]


def test_links_lose_no_pair_of_random_fingerprints(spark):
    r = random.Random(9)
    fps = set()
    for _ in range(40):
        f = r.getrandbits(64)
        for _ in range(12):
            g = f
            for b in r.sample(range(64), r.randint(0, 6)):
                g ^= 1 << b
            fps.add(g)
    numbered = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in numbered.items()], "fp long, rep long")
    classes = brute_components(numbered, 4)
    for tile in (20_000, 3):
        edges = simhash.links(df, 4, tile).collect()
        assert all((numbered[e["u"]] ^ numbered[e["v"]]).bit_count() <= 4 for e in edges)
        parent = {i: i for i in numbered}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for e in edges:
            a, b = sorted((root(e["u"]), root(e["v"])))
            parent[b] = a
        assert {i: root(i) for i in numbered} == classes


def test_key_and_chain_conditions_hold_for_every_near_pair():
    r = np.random.default_rng(3)
    for _ in range(2000):
        bits = r.choice(64, size=r.integers(0, 5), replace=False)
        differ = sum(1 << int(b) for b in bits)
        assert any(differ & m == 0 and all((differ & c).bit_count() <= n for c, n in simhash.chain_masks(4, i)) for i, m in simhash.key_masks(4))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA), shingle=4).count() == 0


def jaccard(a, b, shingle):
    def grams(t):
        w = t.encode().lower().split()
        return {b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_similar_documents(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    base = [[word() for _ in range(r.randint(60, 300))] for _ in range(60)]
    texts, of = [], []
    for i, w in enumerate(base):
        for _ in range(4):
            v = list(w)
            for _ in range(len(v) // 80):
                v[r.randrange(len(v))] = word()
            texts.append(" ".join(v))
            of.append(i)
    texts += [None, "", " \n", "one two"]
    of += [-1, -1, -1, -2]
    df = spark.createDataFrame([(i, t, "x", None, 1) for i, t in enumerate(texts)] + [(None, texts[0], "x", None, 1), (0, texts[0], "x", None, 1)], SCHEMA)
    for tile in (20_000, 40):
        rows = simhash.similar_documents(df, tile=tile).collect()
        assert len(rows) == len(texts) + 2
        got = {x["doc_id"]: x["component"] for x in rows}
        assert got.pop(None) is None
        pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
        assert all(of[i] == of[j] for i, j in pairs if got[i] == got[j])
        near = [(i, j) for i, j in pairs if of[i] == of[j] >= 0 and jaccard(texts[i], texts[j], 5) >= 0.8]
        assert len(near) > 150 and sum(got[i] == got[j] for i, j in near) >= 0.97 * len(near)
        assert len({got[i] for i, o in enumerate(of) if o == -1}) == 1
    assert simhash.similar_documents(df.limit(0)).count() == 0


def test_similar_documents_are_those_of_the_exact_similarity(spark):
    r = random.Random(31)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 9)))
    texts = []
    for _ in range(160):
        w = [word() for _ in range(r.randint(60, 200))]
        v = list(w)
        for _ in range(max(1, round(len(v) * r.uniform(0.01, 0.045)))):
            v[r.randrange(len(v))] = word()
        texts += [" ".join(w), " ".join(v)]
    near = {i for i in range(0, len(texts), 2) if jaccard(texts[i], texts[i + 1], 5) >= 0.8}
    assert 40 < len(near) < 120
    df = spark.createDataFrame([(i, t, "x", None, 1) for i, t in enumerate(texts)], SCHEMA)
    for tile in (20_000, 1):
        got = {x["doc_id"]: x["component"] for x in simhash.similar_documents(df, tile=tile).collect()}
        assert got == {i: i - 1 if i % 2 and i - 1 in near else i for i in range(len(texts))}


def test_no_join_sends_the_corpus_to_the_driver(spark, tmp_path):
    """Under Spark's own threshold: small files of fingerprints are thirty times as many rows once exploded."""
    df = spark.createDataFrame([(i, t, "x", None, 1) for i, t in enumerate(corpus())], SCHEMA)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    out = simhash.near_duplicates(df, shingle=4)
    out.collect()
    assert "BroadcastHashJoin" not in plan(out)
    spark.range(20_000).selectExpr("xxhash64(id) AS fp", "id AS rep").write.parquet(f"{tmp_path}/distinct")
    found = simhash.links(spark.read.parquet(f"{tmp_path}/distinct"))
    assert all("BuildLeft" not in line for line in plan(found).splitlines())


def test_texts_under_one_id_do_not_join_their_classes(spark):
    r = random.Random(8)
    one, two = (" ".join(r.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + str(r.randint(0, 99)) for _ in range(80)) for _ in range(2))
    df = spark.createDataFrame([(1, one, "x", None, 1), (1, two, "x", None, 1), (2, one, "x", None, 1), (3, two + " end", "x", None, 1)], SCHEMA)
    got = simhash.near_duplicates(df, shingle=4).collect()
    assert len({row["class"] for row in got}) == 2 and {row["component"] for row in got} == {1}
