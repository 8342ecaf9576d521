import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from pagemill.llm import outliers as O

SCHEMA = "doc_id long, text string, lang string, source string, kept string, d2 int, key long"


def brute_statistics(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(grams)
    inside = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 8)}
    n, chars, symbols, dup, rep = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)
    return n, chars, symbols, dup, rep, n < 20 or 100 * rep > 30 * n


def half_up(x):
    return math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)


def vector(n, chars, symbols, dup, rep):
    m = max(n, 1)
    return [half_up(1000 * v) for v in (math.log(max(chars, 1) / m), math.log1p(100 * symbols / max(chars, 1)), math.sqrt(dup / m), math.sqrt(rep / m))]


RIDGE = 150.0**2


def logdet(x):
    """log determinant of the covariance of vectors, floor included."""
    x = np.array(x, float)
    return np.linalg.slogdet((x - x.mean(axis=0)).T @ (x - x.mean(axis=0)) / len(x) + np.eye(4) * RIDGE)[1]


def distances(x, mean, cov):
    y = np.linalg.solve(np.linalg.cholesky(cov), (np.atleast_2d(x) - mean).T)
    return (y**2).sum(axis=0)


def random_search(x, share, tries=300):
    """Least log determinant over random starts of five vectors, with exact concentration steps to the end."""
    x, r, best = np.array(x, float), np.random.default_rng(5), math.inf
    h = math.ceil(len(x) * share)
    for _ in range(tries):
        inside, before = x[r.choice(len(x), 5, replace=False)], math.inf
        while True:
            mean = inside.mean(axis=0)
            cov = (inside - mean).T @ (inside - mean) / len(inside) + np.eye(4) * RIDGE
            inside = x[np.argsort(distances(x, mean, cov), kind="stable")[:h]]
            if logdet(inside) >= before - 1e-12:
                break
            before = logdet(inside)
        best = min(best, before)
    return best


def documents():
    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoinshré") for _ in range(r.randint(1, 9)))
    out = [None, "", " \n\t", "x" * 60_000, "w " * 40_000, "a b c d e f g h i", " ".join("abcdefgh" * 2) + " i j k l", "one\none\n\n \none\r\n" + "p q r s t u v w x y z " * 3]
    for i in range(330):
        words = [word() for _ in range(r.randint(18, 120))]
        if i % 11 == 0:
            words = [w + r.choice(["***", "###", "|"]) for w in words]
        if i % 13 == 0:
            words = words[:20] * 3
        if i % 17 == 0:
            words[5:5] = words[:9]
        out.append(r.choice([" ", "\n", "  \t"]).join(words))
    groups = [("en", "hot"), ("en", "hot"), ("en", "b"), ("de", "c"), (None, None), ("fr", None)]
    return [(i, t, *groups[i % 6 if i % 23 else 5]) for i, t in enumerate(out)]


def matrices(row, letter="c"):
    c = np.array([[row[f"{letter}{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])
    return np.array([row[f"m{i}"] for i in range(4)]), c


def cells_of(spark, groups):
    tall = [(g, *map(int, v), n) for g, xs in groups.items() for v, n in Counter(map(tuple, xs)).items()]
    return spark.createDataFrame(tall, "g string, x0 long, x1 long, x2 long, x3 long, w long").repartition(3)


def test_least_determinant_of_all_subsets(spark):
    """Small groups: the estimate's determinant is that of the best of all subsets of nine out of twelve."""
    r = np.random.default_rng(4)
    groups = {}
    for k in range(12):
        x = r.normal(0, [400, 900, 300, 700], (12, 4)) @ (np.eye(4) + r.normal(0, 0.4, (4, 4)))
        if k % 2:
            x[:3] += r.choice([-1, 1], 4) * r.uniform(4_000, 9_000, (3, 4))
        groups[f"g{k}"] = np.rint(x)
    got = {e["g"]: e["logdet"] for e in O.estimates(cells_of(spark, groups)).collect()}
    exact = 0
    for g, x in groups.items():
        best = min(logdet(x[list(s)]) for s in itertools.combinations(range(12), 9))
        assert got[g] >= best - 1e-6 or got[g] > best - 0.05
        exact += abs(got[g] - best) < 1e-6
        assert int(g[1:]) % 2 == 0 or abs(got[g] - best) < 1e-6, (g, got[g], best)
    assert exact >= 9


def test_larger_groups_reach_a_random_search(spark):
    r = np.random.default_rng(9)
    groups = {}
    for k, n in enumerate((60, 200, 400)):
        x = r.normal(0, [400, 900, 300, 700], (n, 4)) @ (np.eye(4) + r.normal(0, 0.3, (4, 4)))
        x[: n // 5] = r.normal(0, 200, (n // 5, 4)) + [5_000, 0, -4_000, 3_000]
        groups[f"g{k}"] = np.rint(x)
    for e in O.estimates(cells_of(spark, groups)).collect():
        assert e["logdet"] <= random_search(groups[e["g"]], 0.75) + 0.03, e["g"]
        mean, _ = matrices(e)
        assert abs(mean).max() < 400


def drawn(own, n, parent, prior=50):
    w = n / (n + prior)
    apart = own[0] - parent[0]
    return w * own[0] + (1 - w) * parent[0], w * own[1] + (1 - w) * parent[1] + w * (1 - w) * np.outer(apart, apart)


def test_documents_are_judged_by_their_group(spark):
    docs = documents()
    rows = [(*d, "clash", 1, 7) for d in docs]
    df = spark.createDataFrame(rows + rows[9:11] + [(None, docs[20][1], "en", "hot", None, None, None)], SCHEMA).repartition(3)
    got = O.judged(df).collect()
    assert len(got) == len(rows) + 3
    everything = [*docs, *docs[9:11], (None, docs[20][1], "en", "hot")]
    stats = [brute_statistics(d[1]) for d in everything]
    members = defaultdict(list)
    for d, s in zip(everything, stats):
        if not s[5]:
            for g in (("s", d[2], d[3]), ("l", d[2]), ("all",)):
                members[g].append(vector(*s[:5]))
    told = {repr(g): g for g in members}
    found = {told[e["g"]]: matrices(e) for e in O.estimates(cells_of(spark, {repr(g): x for g, x in members.items()})).collect()}
    found = {g: (m, c * O.consistency(0.75)) for g, (m, c) in found.items()}
    for g, x in members.items():
        if len(x) > 40:
            assert np.linalg.slogdet(found[g][1] / O.consistency(0.75) + np.eye(4) * RIDGE)[1] <= random_search(x, 0.75, 60) + 0.05
    assert any(len(x) < 50 for x in members.values())
    want = {}
    for d, s in zip(everything, stats):
        d2 = None
        if not s[5]:
            lang = drawn(found["l", d[2]], len(members["l", d[2]]), found["all",])
            mean, cov = drawn(found["s", d[2], d[3]], len(members["s", d[2], d[3]]), lang)
            d2 = distances(vector(*s[:5]), mean, cov + np.eye(4) * RIDGE)[0]
        want[d[0]] = (*s, d2)
    rejected = 0
    for row in got:
        *base, d2 = want[row["doc_id"]]
        assert [row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")] == base, row
        if d2 is None:
            assert row["d2"] is None and not row["kept"]
        else:
            assert abs(row["d2"] - d2) < 1e-6 * max(1, d2)
            assert row["kept"] == (d2 <= 19.9977)
            rejected += not row["kept"]
    assert rejected >= 10


def test_chi_square():
    assert abs(O.chi_square_quantile(0.9995, 4) - 19.9977) < 0.01 and abs(O.chi_square(O.chi_square_quantile(0.75, 4), 4) - 0.75) < 1e-9
    r = np.random.default_rng(1).normal(0, 1, (400_000, 4))
    inside = r[np.argsort((r**2).sum(axis=1))[:300_000]]
    assert abs(np.cov(inside.T).trace() / 4 * O.consistency(0.75) - 1) < 0.01


def test_small_and_empty_tables(spark):
    few = spark.createDataFrame([(i, " ".join(str(j) for j in range(40)), "en", "s", None, None, None) for i in range(3)], SCHEMA)
    assert [(r["d2"], r["kept"]) for r in O.judged(few).collect()] == [(0.0, True)] * 3
    assert O.judged(few.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, "too few", "en", "s", None, None, None), (2, None, None, None, None, None, None)], SCHEMA)
    assert [(r["d2"], r["kept"]) for r in O.judged(bad).collect()] == [(None, False)] * 2
