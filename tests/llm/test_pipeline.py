import random

import corpus_pipeline
from pagemill.llm import bpe
from pagemill.llm.queries import tokenizer_file


def folder(spark, path):
    r = random.Random(4)
    word = lambda: "".join(r.choice("etaoinshrd") for _ in range(r.randint(2, 8)))
    rows = []
    item = " ".join(word() for _ in range(25))
    for i in range(260):
        good = [word() for _ in range(r.randint(40, 150))]
        if i % 5 == 4:
            good = [w.upper() + "!!###" for w in good]
        rows.append([i, " ".join(good)])
    rows[1][1] = rows[0][1]
    rows[2][1] = rows[0][1] + " " + word()
    rows[3][1] += " " + item
    rows[5][1] += " call +1 (988) 555-2485"
    other = " ".join(word() for _ in range(90))
    rows += [[1000, None], [1001, ""], [None, rows[6][1]], [7, rows[7][1]], [8, other], [1002, "long " * 30_000]]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    for name, data, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", [(i, int(i % 5 != 4), 0) for i in range(260)], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, item)], "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return {i: t for i, t in rows}


def test_stages_take_effect(spark, tmp_path):
    texts = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r["doc_id"] for r in docs.collect()]
        assert name == "encoding" or docs.columns == columns
    junk = {i for i in range(260) if i % 5 == 4}
    assert len(junk & set(kept["quality"])) <= 2 and len(set(range(260)) - junk - set(kept["quality"])) <= 4
    near = kept["near_duplicates"]
    assert 0 in near and not {1, 2} & set(near) and near.count(7) == 1 and near.count(8) == 2 and None in near
    assert len(set(near)) >= len(set(kept["quality"])) - 3
    assert set(near) - set(kept["decontamination"]) == {3}
    assert sorted(map(str, kept["pii"])) == sorted(map(str, kept["encoding"])) == sorted(map(str, kept["decontamination"]))
    changed = {r["doc_id"]: (r["text"], r["n_chars"]) for r in spark.read.parquet(f"{tmp_path}/pii").collect()}
    assert "988" not in changed[5][0][-20:] and changed[5][1] == len(changed[5][0]) and changed[10][0] == texts[10]
    assert "988) 555-2485" not in str(changed[5])
    ids = {r["doc_id"]: r["n_tokens"] for r in docs.collect()}
    assert ids[10] == len(bpe.codec(tokenizer_file()).encode(texts[10])) // 4
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["encoding"])


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    """Stages keep columns whose names they use themselves, and empty tables of every kind."""
    names = "doc_id long, text string, lang string, source string, n_chars long, th long, key string, score double, component long, _row int"
    text = "some plain words that nobody has repeated in any other row of this small table"
    rows = [(1, text, "en", "s", len(text), 5, "k", 0.1, 9, 3), (2, None, None, None, None, None, None, None, None, None)]
    for i, (docs, labels, items) in enumerate([(rows, [], []), ([], [], [])]):
        for name, data, schema in (("documents", docs, names), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
            spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{i}/{name}.parquet")
        out = spark.read.parquet(f"{tmp_path}/{i}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, out, f"{tmp_path}/{i}")
            assert out.columns == [x.split()[0] for x in names.split(", ")], name
        assert sorted(tuple(r) for r in out.collect()) == rows[:len(docs)]


def test_near_copies_are_those_of_the_fingerprints(spark, tmp_path):
    """The stage keeps the least id of each class that op2's method finds, and nothing else goes."""
    from pagemill.llm import simhash

    r = random.Random(17)
    word = lambda: "".join(r.choice("etaoinshrd") for _ in range(r.randint(2, 8)))
    texts = []
    for _ in range(40):
        w = [word() for _ in range(r.randint(60, 200))]
        for changes in (0, 1, 2, 4, 6):
            v = list(w)
            for _ in range(changes):
                v[r.randrange(len(v))] = word()
            texts.append(" ".join(v))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    fps = [simhash.fingerprint(t, 4) % (1 << 64) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    kept = sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())
    assert kept == [i for i in range(len(texts)) if root(i) == i] and len(kept) < len(texts)
