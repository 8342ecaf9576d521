"""Queries against their DuckDB SQL on a small folder, and every query's columns."""

import random
from pathlib import Path

import duckdb
import pytest

from pagemill.llm import queries

COLUMNS = {
    "op1_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op2_simhash": {"doc_id", "fingerprint", "component_id"},
    "op3_templates": {"doc_id", "contaminated", "item_id"},
    "op4_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op5_substring": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op6_outliers": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op7_wordpiece": {"doc_id", "n_words", "n_pieces"},
    "op8_pseudonyms": {"doc_id", "n_replaced", "text"},
    "op9_mil": {"doc_id", "held_out", "score", "predicted"},
    "op10_suffix": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    r = random.Random(6)
    word = lambda: "".join(r.choice("etaoinshrdé") for _ in range(r.randint(1, 8)))
    common = " ".join(word() for _ in range(70))
    texts = [" ".join(word() for _ in range(r.randint(1, 150))) for _ in range(40)]
    texts += [t + "\n" + common for t in texts[:12]] + texts[:5] + ["", "x " * 120, None]
    docs = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    pages = [(i, f"http://h/{i}", r.choice(["<p>a</p>", "", None, "<b>é</b>", f"<i>{i}</i>"])) for i in range(50)]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("pages", pages, "page_id long, url string, html string"),
        ("labels", [(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, common)], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, folder, name):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    df = queries.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    result = con.execute(oracle := queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns, oracle
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_columns_and_rows(spark, folder, name):
    df = queries.queries()[name](spark, str(folder))
    assert set(df.columns) >= COLUMNS[name]
    assert df.count() == spark.read.parquet(f"{folder}/{'pages' if name == 'op4_warc' else 'documents'}.parquet").count()


def test_all_ten_are_registered():
    assert set(queries.queries()) == set(COLUMNS)
