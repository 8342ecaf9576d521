import base64
import hashlib

import pytest

from pagemill.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, record_id int"


def pages():
    texts = ["<p>a</p>", "", None, "é" * 10, "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n", "x" * 300_000, "<p>a</p>", "\r\n\r\n", "<p>a</p>", ""]
    return [(i, f"http://h{i % 3}.example/{i}\r\nx" if i != 4 else None, t, "clash", 0) for i, t in enumerate(texts)]


def expected(rows, least):
    out = {}
    for i, _, t, *_ in rows:
        data = (t or "").encode()
        last = max(j for j, _, u, *_ in rows if (u or "") == (t or ""))
        revisit = len(data) >= least and last != i
        out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last if revisit else None)
    return out


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, compression, least, tmp_path):
    rows = pages()
    warc.register(spark)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    folder = f"file://{tmp_path}/archive"
    warc.records(df, least).write.format("warc").option("compression", compression).option("file_bytes", 2_000).mode("append").save(folder)
    back = warc.read(spark, folder, verify="true").collect()
    number = lambda x: int(x.rpartition(":")[2]) if x else None
    assert {number(r["record_id"]): (r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in back} == expected(rows, least)
    for r in back:
        if r["record_type"] == "response":
            assert bytes(r["payload"]).decode() == (rows[number(r["record_id"])][2] or "")
        else:
            assert r["payload"] is None
    assert not [p for p in (tmp_path / "archive").iterdir() if p.name.startswith("_")]


def test_predicates_are_pushed_and_payloads_left(spark):
    df = spark.createDataFrame(pages(), SCHEMA)
    folder = warc.archive(df)
    some = warc.read(spark, folder, "record_id string, record_type string, payload_bytes long").where("record_type = 'revisit'")
    assert sorted(r["record_id"] for r in some.collect()) == ["urn:page:0", "urn:page:1", "urn:page:2", "urn:page:6"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "revisit" not in plan
    reader = warc.WarcReader(some.schema, {"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3), StringStartsWith(("record_id",), "urn:")]))
    assert len(left) == 1 and len(reader.tests) == 2


def test_null_key_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, None, "same", "", 0), (3, "u", "same", "", 0), (3, "u", "same", "", 0)], SCHEMA)
    got = sorted((r["record_id"], r["record_type"]) for r in warc.read(spark, warc.archive(df)).collect())
    assert got == [("urn:page:", "response"), ("urn:page:3", "response"), ("urn:page:3", "response")]
    empty = warc.archive(spark.createDataFrame([], SCHEMA))
    assert warc.read(spark, empty).count() == 0


def test_broken_archives_are_reported(spark, tmp_path):
    (tmp_path / "bad.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort")
    with pytest.raises(Exception, match="cut off"):
        warc.read(spark, str(tmp_path / "bad.warc"), "record_type string, block_bytes long").where("record_type = 'x'").collect()
