import math
import random
import re

from pyspark.sql import functions as F

from pagemill.llm import decontaminate as D

DOCS = "doc_id long, text string, item_id string, slots int, key string"
ITEMS = "item_id long, text string, doc_id int, n_windows int"
A = "A train leaves Boston at 45 mph while another train leaves from the station in Boston after 3 hours and travels 45 km until both of them meet."
B = "Every student in this class reads two books each week during the whole summer term without asking the teacher for help."
REPARAMETERISED = A.replace("Boston", "Denver").replace("45", "60").replace(" 3 ", " 5 ")
INCONSISTENT = A.replace("45 mph", "60 mph").replace("at Boston", "x").replace("leaves Boston", "leaves Denver")


def run(spark, docs, items, **args):
    d = spark.createDataFrame(docs, DOCS).repartition(3)
    found = D.contamination(d, spark.createDataFrame(items, ITEMS), **args)
    return {r["doc_id"]: r for r in D.flagged(d, found).collect()}, D.flagged(d, found).count()


def test_exact_reparameterised_and_clean(spark):
    filler = "some unrelated words that go on and on for a while in this text "
    texts = [A, filler * 3 + A + " " + filler, filler + REPARAMETERISED, filler + INCONSISTENT, filler * 20, B.upper(), None, "", A + "\n" + B, " ".join(A.split()[:14]), "word " * 40_000, "1 2 3 " * 50, "Ann Bob Cid " * 40]
    docs = [(i, t, "c", 1, "k") for i, t in enumerate(texts)] + [(1, texts[1], "c", 1, "k"), (None, A, None, None, None)]
    items = [(1, A, 0, 0), (2, B, 0, 0), (3, None, 0, 0), (4, "", 0, 0), (5, "too short", 0, 0), (6, A, 0, 0), (None, B, 0, 0)]
    for rows in (500_000, 1):
        got, n = run(spark, docs, items, broadcast_rows=rows)
        assert n == len(docs)
        dirty = {i for i, r in got.items() if r["contaminated"]}
        assert dirty >= {0, 1, 2, 8} and not dirty & {3, 4, 6, 7, 9, 10, 11, 12, None}
        assert got[0]["item_id"] == 1 and got[0]["n_items"] == 1 and got[0]["same_values"] and got[1]["same_values"]
        assert got[2]["same_values"] is False and got[8]["n_items"] == 2


def test_short_items_and_empty_tables(spark):
    short = "which planet is the largest"
    docs = [(1, f"so they asked {short} of all", "", 0, ""), (2, "which planet was it", "", 0, "")]
    got, _ = run(spark, docs, [(1, short, 0, 0), (2, A, 0, 0)])
    assert got[1]["contaminated"] and not got[2]["contaminated"]
    got, _ = run(spark, docs, [])
    assert not any(r["contaminated"] for r in got.values())
    got, n = run(spark, [], [(1, A, 0, 0)])
    assert n == 0


def test_templates(spark):
    texts = ['He paid $1,200.50 for 3 kg. Then Mary and Étienne (twelve) in 5 cm', '"Stop!" He ran to "Ann." Bob  said: yes\x01 one.\n\nNext 3.5% of O\'Brien, ok', "", "... !?", "a  -  b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r for r in df.select("i", D.words(df["t"]).alias("w"), F.transform(D.words(df["t"]), D._kind).alias("shape")).collect()}
    n, u, p = D.NUMBER, D.UNIT, D.NAME
    assert got[0]["shape"] == ["he", "paid", n, "for", n, u, "then", p, "and", p, n, "in", n, u]
    assert got[0]["w"] == ["he", "paid", n + "$1,200.50", "for", n + "3", u + "kg", "then", p + "mary", "and", p + "étienne", "twelve", "in", n + "5", u + "cm"]
    assert got[1]["shape"] == [p, "he", "ran", "to", p, p, "said", "yes", n, p, n, "of", p, "ok"]
    assert got[2]["shape"] == [] and got[3]["shape"] == [] and got[4]["shape"] == ["a", "-", "b"]


def brute_words(text):
    """(template word, value) pairs by the rules, word by word."""
    text = re.sub(r"[.,:]+(?![0-9])", " ", text or "")
    for mark in '!?;"()[]{}<>“”«»…\t\n\x0b\x0c\r\x01':
        text = text.replace(mark, " ")
    out = []
    for w in re.sub("['‘’]", "", text).split(" "):
        low = w.lower()
        if not w:
            continue
        if w[0].isupper() and low not in D.OPENERS:
            kind = D.NAME
        elif re.fullmatch(r"[$+\-]?[0-9][0-9.,/:]*%?", w) or low in D.NUMBER_WORDS:
            kind = D.NUMBER
        elif low in D.UNITS and out and out[-1][0] == D.NUMBER and out[-1][1] not in D.NUMBER_WORDS:
            kind = D.UNIT
        else:
            kind = low
        out.append((kind, low))
    return out


def one_to_one(pairs):
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def brute_contamination(docs, items, window=8, share=0.5, least=4):
    """Every window of every item against every window of every document."""
    typed = (D.NUMBER, D.UNIT, D.NAME)
    found = {}
    for item, text in items:
        words = brute_words(text)
        n = len(words)
        size = min(window, n)
        shape = lambda ws: tuple(k for k, _ in ws)
        every = {q: shape(words[q : q + size]) for q in range(n - size + 1)}
        loose = {q: s for q, s in every.items() if 2 * sum(x in typed for x in s) <= size}
        rule = 2 if not loose or n < least else 1 if n < window else 0
        known = loose or every
        for doc, body in docs:
            there = brute_words(body)
            good, shifts = set(), {}
            for p in range(len(there) - size + 1):
                for q in known:
                    if known[q] == shape(there[p : p + size]) and (n >= least or len(there) == n):
                        pairs, qs = shifts.setdefault(p - q, (set(), set()))
                        qs.add(q)
                        pairs |= {(k, a, b) for (k, a), (_, b) in zip(words[q : q + size], there[p : p + size]) if k in typed}
            for pairs, qs in shifts.values():
                names = {(a, b) for k, a, b in pairs if k != D.NUMBER}
                numbers = {(a, b) for k, a, b in pairs if k == D.NUMBER}
                strict = {2: names | numbers, 1: names, 0: set()}[rule]
                if one_to_one(names) and len(numbers) == len({a for a, _ in numbers}) and all(a == b for a, b in strict):
                    good |= qs
            if known and n and len(good) >= math.ceil(len(known) * share):
                found[doc, item] = len(good)
    return found


def test_equals_brute_force(spark):
    r = random.Random(21)
    plain = "train leaves the station and reaches town while children walk along river banks counting boats near old bridge".split()

    def word():
        kind = r.random()
        if kind < 0.1:
            return f"{r.randint(1, 99)}{r.choice(['', '.5', '%'])}" + r.choice(["", " km", " hours", " kg,"])
        if kind < 0.2:
            return r.choice(["Ann", "Bob", "Élodie", "Kyiv,", '"Max"'])
        return r.choice(plain) + r.choice(["", "", "", ",", ".", "!", ".)"]) if kind < 0.95 else r.choice(["three", "ten", "(two)"])

    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(r.randint(1, 28))) for i in range(14)] + [(14, " ".join(["train leaves Ann 5 km"] * 5)), (15, "Ann 5 km Bob 3 kg " * 3), (16, "old bridge")]
    swap = {"Ann": "Eve", "Bob": "Ann", "Kyiv,": "Rome,", "three": "nine"}
    docs = []
    for i in range(140):
        body = r.choice(items)[1]
        kind = r.randrange(5)
        if kind == 1:
            body = " ".join(swap.get(w, w) for w in body.split())
        elif kind == 2:
            body = " ".join(r.choice(["7", "8"]) if w.isdigit() else w for w in body.split())
        elif kind == 3:
            w = body.split()
            w[r.randrange(len(w))] = "other"
            body = " ".join(w)
        elif kind == 4:
            body = text(20)
        docs.append((i, body if i % 7 == 0 else text(r.randint(0, 20)) + " " + body + "\n" + text(r.randint(0, 20))))
    want = brute_contamination(docs, items)
    assert 60 < len(want) < 140
    df = spark.createDataFrame([(*d, "x", 0, "k") for d in docs], DOCS)
    found = D.contamination(df, spark.createDataFrame([(*i, 0, 0) for i in items], ITEMS)).collect()
    assert {(f["doc_id"], f["item_id"]): f["hits"] for f in found} == want


WORD_PROBLEM = "Tom has 5 apples and 3 pears. Tom gives Ann 2 apples. How many fruits does Tom have now?"


def test_names_that_begin_a_sentence_and_numbers_that_become_equal(spark):
    renamed = WORD_PROBLEM.replace("Tom", "Bob").replace("5", "7")
    equal = WORD_PROBLEM.replace("5", "4").replace("3", "4")
    docs = [(i, t, "", 0, "") for i, t in enumerate([renamed, equal, INCONSISTENT, "Some words: " + renamed, WORD_PROBLEM.lower()])]
    got, _ = run(spark, docs, [(1, WORD_PROBLEM, 0, 0), (2, A, 0, 0)])
    assert [got[i]["contaminated"] for i in range(4)] == [True, True, False, True]


def test_what_stands_before_an_item_does_not_matter(spark):
    item = "Which planet is the largest?"
    before = ["Question: ", "Quiz\n", "", "They asked. ", "so they asked "]
    docs = [(i, b + item + " Nobody knew.", "", 0, "") for i, b in enumerate(before)]
    docs += [(10, "asked which planet is the largest", "", 0, ""), (11, "Quiz\nEvery planet is the largest", "", 0, "")]
    got, _ = run(spark, docs, [(1, item, 0, 0), (2, A, 0, 0)])
    assert {i for i, r in got.items() if r["contaminated"]} == {0, 1, 2, 3, 4, 10}


def test_texts_under_one_key_and_shared_templates(spark):
    """Each text of a key is judged by itself; a template of many items makes no pair of each document and item."""
    common = "which of the following words is the right answer to it"
    items = [(i, f"{common}: {w} or the other word that stands beside it on the long list", 0, 0) for i, w in enumerate("alpha beta gamma delta epsilon zeta eta theta".split())]
    docs = [(1, items[0][1], "", 0, ""), (1, "nothing of the kind", "", 0, ""), (2, common + " there", "", 0, "")]
    d = spark.createDataFrame(docs, DOCS)
    found = D.contamination(d, spark.createDataFrame(items, ITEMS))
    got = sorted((r["doc_id"], r["contaminated"], r["n_items"]) for r in D.flagged(d, found).collect())
    assert got[0] == (1, False, 0) and got[1][:2] == (1, True) and got[2] == (2, False, 0)
    assert sorted(r["doc_id"] for r in D.clean(d, found).collect()) == [1, 2]


def test_recall_on_reparameterised_items(spark):
    """Names, numbers and units of items are replaced throughout; of 200, at least 180 must be found."""
    r = random.Random(8)
    plain = "train leaves the station and reaches town while children walk along river banks counting boats near old bridge".split()
    docs, items = [], []
    for i in range(200):
        ws = [r.choice(["Tom", "Ann", "Leo"]) if (x := r.random()) < 0.12 else str(r.randint(2, 60)) if x < 0.24 else r.choice(plain) for _ in range(r.randint(12, 40))]
        items.append((i, " ".join(ws) + ".", 0, 0))
        names = dict(zip(["Tom", "Ann", "Leo"], r.sample(["Bo", "Eva", "Kim", "Sue"], 3)))
        numbers = {str(n): str(r.randint(2, 99)) for n in range(2, 61)}
        docs.append((i, "Some words before: " + " ".join(names.get(w, numbers.get(w, w)) for w in ws) + ". And after.", "", 0, ""))
    docs += [(1000 + i, " ".join(r.choice(plain) for _ in range(60)), "", 0, "") for i in range(200)]
    got, _ = run(spark, docs, items)
    caught = sum(got[i]["contaminated"] for i in range(200))
    assert caught >= 180 and not any(got[1000 + i]["contaminated"] for i in range(200)), caught
