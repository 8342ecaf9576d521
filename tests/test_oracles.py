"""Every registered query against its DuckDB SQL, on a small folder made here."""

import random
from pathlib import Path

import duckdb
import pytest

from pagemill.plans import oracles, queries

FIXTURE_ROWS = 60


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    r = random.Random(3)
    words = "the of and data Étude model café page x1 42 line value summary total when where alpha beta gamma delta ñandú".split()
    sentence = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 14))).capitalize() + r.choice([". ", "? ", "; ", "\n", ".\n\n", " \t", "\r\n"])
    text = lambda n: "".join(sentence() for _ in range(r.randint(1, n)))
    docs = [(i, text(40) + ("Common footer\n" if i % 4 == 0 else "") + ("http://a.example/x\n" if i % 9 == 0 else ""), "en", f"src{i % 6}", 0) for i in range(FIXTURE_ROWS)]
    docs[7] = (7, "", "en", "src1", 0)
    docs[8] = (8, "12 34 .. 56 -- 78 90 12 34", "en", "src2", 0)
    docs[13] = (13, "word " * 900, "en", "src1", 0)
    docs = [(*d[:4], len(d[1])) for d in docs]
    conv = [(c, t, "user" if t % 2 == 0 else "assistant", text(6)) for c in range(30) for t in range(4)]
    vec = []
    for i in range(120):
        v = [r.gauss(0, 1) for _ in range(8)]
        n = sum(x * x for x in v) ** 0.5
        vec.append((i, [x / n for x in v], i % 3))
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("benchmark", [(i, text(3)) for i in range(24)], "item_id long, text string"),
        ("pages", [(i, f"http{'s' * (i % 2)}://h.example/{i}{'.' * (i % 3)}", "<p>") for i in range(40)], "page_id long, url string, html string"),
        ("conversations", conv, "conv_id long, turn long, role string, text string"),
        ("embeddings", vec, "vec_id long, embedding array<float>, label int"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_oracle(spark, folder, duck, name):
    df = queries.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(oracles.SQL[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
    assert sorted(names) == columns
    assert got == want


def test_only_word_errors_have_no_oracle():
    assert set(queries.QUERIES) - set(oracles.SQL) == {"word_error_rates"}
