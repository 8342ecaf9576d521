"""Rules of single operators, on literal rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.config import DEFAULT, Settings
from pagemill.functions import confidence as C
from pagemill.functions import text as T
from pagemill.operators import answering as A
from pagemill.operators import chunking, evaluation, layout, ranking


def values(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["v"] for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normal_form_and_tokens(spark):
    assert values(spark, ["a\r\nb\rc", "x  \t y", "a \n\n\n\n b", None, "  5 km² ", " z"], T.normalize) == ["a\nb\nc", "x y", "a\n\nb", "", "5 km²", "z"]
    assert values(spark, ["What is the café's 3x4 Plan-B?", None, "I a at"], T.tokens) == [["caf", "3x4", "plan"], [], []]
    assert values(spark, ["## # a #", " # ", None], T.clean_line) == ["a #", "", ""]
    assert values(spark, ["HTTP://x.y).", "www.a.b", "see www.a", "https://", "www. x"], T.is_url_line) == [True, True, False, False, False]
    assert values(spark, ["a/b.tar.GZ", "x\\Y.Pdf", ".txt", "none", "d.x/f"], T.extension) == [".gz", ".pdf", "", "", ""]
    assert values(spark, ["abc def ghi jkl mno pqr", "12345 67890 12345 67890", "abcdefghij 0123456789", "short"], T.printed_is_usable) == [True, False, True, False]


def test_chunks_are_parts_of_the_page(spark):
    r = random.Random(1)
    for _ in range(300):
        text = " ".join("".join(r.choice("abc") for _ in range(r.randint(1, 9))) + r.choice(["", "", ".", "\n", ";"]) for _ in range(r.randint(1, 400))).strip()
        chunks = chunking.cut_text(text, 400, 60)
        at = 0
        for c in chunks:
            assert 0 < len(c) <= 400
            at = text.index(c, max(0, at - 61))
            at += len(c)
        assert text.startswith(chunks[0]) and text.endswith(chunks[-1])
    assert [len(c) for c in chunking.cut_text("x" * 1000, 400, 60)] == [400, 400, 320]
    assert chunking.cut_text("", 400, 60) == []


def fold(lines, size, overlap):
    """The packing rule one line at a time."""
    out, current, i = [], [], 0
    cost = lambda items: sum(len(lines[j]) + 1 for j in items)
    while i < len(lines):
        if current and cost(current) + len(lines[i]) + 1 > size:
            out.append((current[0], current[-1] + 1))
            tail = []
            for j in reversed(current):
                if overlap <= 0 or (tail and cost(tail) + len(lines[j]) + 1 > overlap):
                    break
                tail.insert(0, j)
            current = tail if tail and cost(tail) + len(lines[i]) + 1 <= size else []
            continue
        current.append(i)
        i += 1
    return out + ([(current[0], current[-1] + 1)] if current else [])


def test_packing_equals_the_line_by_line_rule(spark):
    r = random.Random(2)
    for _ in range(3000):
        lines = ["x" * (r.choice([r.randint(1, 90), r.randint(1, 30), r.randint(300, 900)])) for _ in range(r.randint(0, 40))]
        for overlap in (0, 60, 200):
            assert chunking.pack_lines([len(x) + 1 for x in lines], 400, overlap) == fold(lines, 400, overlap)
    df = spark.createDataFrame([(1, [("good " * 10, 0.93), (" bad ", 0.07), ("  ", 0.0)]), (2, None)], "k int, l array<struct<text:string,confidence:double>>")
    assert [(x["k"], x["text"], x["ocr_confidence"]) for x in chunking.chunk_lines(df, ["k"], "l").collect()] == [(1, ("good " * 10).strip() + "\nbad", 0.07)]


def test_chunk_numbers_run_over_the_document(spark):
    rows = [("D ", p, "digital_text", "pymupdf", i, f"{p}{i}", None) for p in (3, 1, 2) for i in range(2)] + [("e", None, "digital_text", "plaintext", 0, "t", 0.123456)]
    got = chunking.chunk_records(spark.createDataFrame(rows, "document_name string, page_number int, content_type string, extraction_method string, position int, text string, ocr_confidence double")).collect()
    assert sorted((r["chunk_index"], r["text"], r["chunk_id"]) for r in got if r["document_key"] == "d") == [(i, t, f"{t[0]}-{i}") for i, t in enumerate(["10", "11", "20", "21", "30", "31"])]
    last = next(r for r in got if r["document_key"] == "e")
    assert last["chunk_id"] == "0-0" and last["ocr_confidence"] == 0.1235 and len({r["id"] for r in got}) == 7


def test_page_routes(spark):
    head = "Quarterly report 2024"
    rows = [("a", 1, f"{head}\nThe first page has words enough", False), ("a", 2, f"{head}\nThe second page has words too", False), ("a", 3, head, False), ("a", 4, head, True), ("b", 1, "http://a.example/x", False), ("c", 1, None, False)]
    got = {(r["document_name"], r["page_number"]): (r["route"], r["usable_text"]) for r in layout.route_pages(spark.createDataFrame(rows, "document_name string, page_number int, raw_text string, has_image boolean")).collect()}
    assert got["a", 1] == ("digital", "The first page has words enough") and got["a", 3] == ("drop", "") and got["a", 4][0] == "ocr" and got["b", 1][0] == "ocr" and got["c", 1][0] == "ocr"
    budget = layout.ocr_budget(spark.createDataFrame([("d", "ocr")] * 41 + [("e", "ocr")] * 40, "document_name string, route string"), DEFAULT)
    assert {r["document_name"]: r["over_budget"] for r in budget.collect()} == {"d": True, "e": False}


def test_confidences(spark):
    words = spark.createDataFrame([([("a", 90.0), (" ", 10.0), ("b", -1.0), ("c", 71.0)],), ([],), ([("x", -1.0)],)], "w array<struct<text:string,conf:double>>")
    assert [r[0] for r in words.select(C.word_confidence(F.col("w"))).collect()] == [0.805, None, None]
    scores = spark.createDataFrame([([[0.0, 5.0, 0.0], [0.0, 0.0, 5.0]], [0, 1, 2], [2]), ([[1.0, 1.0]], [0, 0], [0])], "s array<array<double>>, q array<int>, k array<int>")
    got = [r[0] for r in scores.select(C.sequence_confidence(F.col("s"), F.col("q"), F.col("k"))).collect()]
    assert abs(got[0] - np.exp(5) / (np.exp(5) + 2)) < 1e-12 and got[1] == 0.0


def test_pool_margin_overview(spark):
    pool = spark.createDataFrame([(10,), (480,), (600,), (5000,)], "n int").select(ranking.candidate_pool(F.col("n")).alias("p"))
    assert [r["p"] for r in pool.collect()] == [24, 24, 30, 40]
    rows = spark.createDataFrame([(1, "a", -7.0, 0.1, 1), (1, "b", -9.0, 0.1, 2)], "query_id int, id string, rerank_score double, rrf_score double, fused_rank int")
    assert ranking.cut_and_order(rows, Settings(rerank_margin=1.5)).count() == 1 and ranking.cut_and_order(rows, Settings(rerank_margin=3.0)).count() == 2
    assert ranking.cut_and_order(rows, Settings(top_k=0)).count() == 0
    deck = spark.createDataFrame([("d", i, i // 2 + 1, f"t{i}") for i in range(10)] + [("d", 10, 9, " ")], "document_key string, chunk_index int, page_number int, text string")
    picked = lambda n: sorted(r["chunk_index"] for r in ranking.overview(deck, n).collect())
    assert picked(5) == [0, 2, 4, 6, 8] and picked(4) == [0, 2, 5, 7] and picked(10) == list(range(10)) == picked(99) and picked(0) == []
    for n, limit in ((30, 22), (97, 13), (7, 6)):
        many = spark.createDataFrame([("d", i, 1, "t") for i in range(n)], "document_key string, chunk_index int, page_number int, text string")
        assert sorted(r["chunk_index"] for r in ranking.overview(many, limit).collect()) == [int(i * (n / limit)) for i in range(limit)]


def test_bm25_needs_three_chunks_and_fusion_adds_ranks(spark):
    chunks = lambda texts: spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "document_key string, chunk_index int, text string")
    asked = spark.createDataFrame([(1, "d", "river water water")], "query_id int, document_key string, question string")
    assert ranking.bm25_ranking(asked, chunks(["river water"])).count() == 0
    assert ranking.bm25_ranking(asked, chunks(["river water", "lease"])).count() == 0
    got = ranking.bm25_ranking(asked, chunks(["river", "lease rent", "water water tower", "office"])).orderBy("rank").collect()
    assert [r["chunk_index"] for r in got] == [2, 0]
    ranks = lambda ids: spark.createDataFrame([(1, "d", i, n) for n, i in enumerate(ids, 1)], "query_id int, document_key string, chunk_index int, rank int")
    fused = {r["chunk_index"]: (r["rrf_score"], r["fused_rank"]) for r in ranking.fuse(ranks([7, 3]), ranks([7, 5])).collect()}
    assert fused == {7: (round(2 / 61, 6), 1), 3: (round(1 / 62, 6), 2), 5: (round(1 / 62, 6), 3)}


SOURCE = "struct<text:string,filename:string,page_number:int,content_type:string,ocr_confidence:double>"
GOOD, OTHER = ("The sky is blue. Grass is green.", "f", 2, "digital_text", None), ("Snow is white", "f", 0, "handwritten_ocr", 0.4)
DARK = ("unread", "f", 1, "handwritten_ocr", None)
CASES = {
    "no sources": ([], "x [S1]", None, "no_evidence", None),
    "blank source": ([(" ", "f", 1, "digital_text", None)], "x [S1]", None, "no_evidence", None),
    "low confidence": ([DARK, ("t", "f", 1, "digital_text", 0.29)], "x [S1]", None, "low_handwriting_confidence", None),
    "refusal": ([GOOD], f" {A.NOT_FOUND}\n", None, "not_answerable", None),
    "empty": ([GOOD], None, None, "not_answerable", None),
    "only a header": ([GOOD], "[S1 | f, page 2 | digital_text]", None, "not_answerable", None),
    "header and refusal": ([GOOD], f"[S1 | f | digital_text] {A.NOT_FOUND}", None, "not_answerable", None),
    "pasted refusal, then facts": ([GOOD], f"{A.NOT_FOUND} The sky is blue. [S1]", None, None, "The sky is blue. [S1]"),
    "uncited, one source": ([GOOD], "The sky is blue", None, None, "The sky is blue [S1]"),
    "wrong label, one source": ([GOOD], "Grass is green [S2] [S3]", "Grass is green [S2] [S3]", None, "Grass is green [S1]"),
    "invented label twice": ([GOOD, OTHER], "Snow is white [S7]", "Snow is white [S7]", "untraceable_citation", None),
    "second draft": ([GOOD, OTHER], "Snow is white", "Snow is white [S2]", None, "Snow is white [S2]"),
    "second draft refuses": ([GOOD, OTHER], "Snow is white", A.NOT_FOUND, "not_answerable", None),
    "labels only": ([GOOD, OTHER], "[S1] [S2]", None, "unsupported_claim", None),
    "layout marks": ([GOOD], "Grass is green | x [S1]", None, "unsupported_claim", None),
    "one of two": ([GOOD, OTHER], "Snow is white [S2] Coal is red [S1]", None, None, "Snow is white [S2]" + A.PARTIAL_NOTE),
    "beyond the cap": ([GOOD], " ".join(["Grass is green [S1]"] * 7), None, None, " ".join(["Grass is green [S1]"] * 5) + A.PARTIAL_NOTE),
    "unlabelled tail": ([GOOD], "Grass is green [S1] and more", None, None, "Grass is green [S1]"),
}


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = [(k, s, d, r) for k, (s, d, r, _, _) in CASES.items()]
    done = A.answers(spark.createDataFrame(rows, f"case string, sources array<{SOURCE}>, draft string, retry string"))
    return {r["case"]: r for r in done.collect()}


@pytest.mark.parametrize("case", CASES)
def test_answer_outcomes(outcomes, case):
    sources, _, _, reason, answer = CASES[case]
    row = outcomes[case]
    assert (row["reason"], row["answer"]) == (reason, answer or A.NOT_FOUND)
    assert len(row["sources"]) == (0 if reason else sum(s[4] is None or s[4] >= 0.3 for s in sources))


def test_context_and_requests(spark):
    df = spark.createDataFrame([([GOOD, (" ", "f", 1, "digital_text", None), OTHER],)], f"s array<{SOURCE}>")
    assert df.select(A.build_context(F.col("s")).alias("c")).first()["c"] == "[S1 | f, page 2 | digital_text]\nThe sky is blue. Grass is green.\n\n[S3 | f | handwritten_ocr]\nSnow is white"
    assert values(spark, ["Please SUMMARISE it", "What topics covered here?", "executive summary date?", "who signed", None], A.is_document_request) == [True, True, True, False, False]
    assert values(spark, ["a [S2] b [S10] [S2]", "none [S]", None], T.labels) == [[2, 10], [], []]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates_equal_edit_distances(spark):
    r = random.Random(5)
    word = lambda: r.choice(["the", "The", "a", "été", "x", "leaf"])
    pairs = [(" ".join(word() for _ in range(r.randint(0, 12))), "\n ".join(word() for _ in range(r.randint(0, 12)))) for _ in range(60)] + [(None, "x"), ("", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for row in df.select("i", evaluation.character_error(F.col("a"), F.col("b")).alias("c"), evaluation.word_error(F.col("a"), F.col("b")).alias("w")).collect():
        a, b = (" ".join((x or "").lower().split()) for x in pairs[row["i"]])
        assert abs(row["c"] - edit(a, b) / max(1, len(a))) < 1e-12 and abs(row["w"] - edit(a.split(), b.split()) / max(1, len(a.split()))) < 1e-12


def test_bands_follow_runs(spark):
    flags = spark.createDataFrame([(1, i, f) for i, f in enumerate([False, True, True, False, False, True])], "k int, row int, f boolean")
    assert sorted((r["start"], r["end"]) for r in layout.islands(flags, ["k"], "row", "f").collect()) == [(1, 3), (5, 6)]


def test_word_error_of_very_many_words(spark):
    from pagemill.operators.evaluation import word_error

    words = [f"w{i}" for i in range(3_000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:1_500] + ["other"] + words[1_501:])), ("", ""), (None, "a")], "t string, h string")
    assert [r["e"] for r in df.select(word_error(F.col("t"), F.col("h")).alias("e")).collect()] == [1 / 3_000, 0.0, 1.0]


def test_chunks_of_a_nameless_document_stay(spark):
    from pagemill.operators.chunking import chunk_records

    rows = [(None, 1, "digital_text", "m", 0, "a", None), (None, 2, "digital_text", "m", 0, "b", None), ("d", None, "digital_text", "m", 0, "c", None)]
    df = spark.createDataFrame(rows, "document_name string, page_number int, content_type string, extraction_method string, position int, text string, ocr_confidence double")
    assert sorted((r["text"], r["chunk_index"]) for r in chunk_records(df).collect()) == [("a", 0), ("b", 1), ("c", 0)]


def test_specks_go_and_crops_stay_inside():
    import numpy as np

    from pagemill.operators import imaging

    page = np.full((120, 200), 255, np.uint8)
    page[40:60, 30:150] = 0
    page[5, 5] = 0
    assert imaging.median_of_nine(page)[5, 5] == 255 and imaging.median_of_nine(page)[50, 90] == 0
    crops = imaging.segment_lines(page)
    assert [c.shape for c in crops] == [(32, 132)]
    assert [c.shape for c in imaging.segment_lines(np.full((50, 40), 255, np.uint8))] == [(50, 40)] and imaging.segment_lines(np.zeros((0, 5), np.uint8)) == []
    assert max(imaging.preprocess(page, True, 100)[0][0].shape) <= 100


def test_error_rates_on_unfolded_text_equal_plain_edit_distance(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    pairs = [("Café  ñandú 日本", "cafe ñandu 日"), ("😀 smile 😀", "smile 😀 😁"), ("", "é"), ("é", None), ("a b a b", "b a b a"), ("x", "x")]
    df = spark.createDataFrame(pairs, "truth string, hypothesis string")
    got = df.select("truth", "hypothesis", evaluation.character_error(F.col("truth"), F.col("hypothesis")).alias("c"), evaluation.word_error(F.col("truth"), F.col("hypothesis")).alias("w")).collect()
    for r in got:
        a, b = (" ".join((x or "").lower().split()) for x in (r["truth"], r["hypothesis"]))
        assert r["c"] == pytest.approx(distance(a, b) / max(1, len(a)))
        assert r["w"] == pytest.approx(distance(a.split(), b.split()) / max(1, len(a.split())))


def test_edit_distances_take_work_by_distance_not_length():
    import time

    from pagemill.operators.distance import edit_distances

    r = random.Random(6)
    for letters in ("ab", "abcdefgh ", "aé日", "a😀\U0010ffff", "a\xff\xfe"):
        a = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(150)]
        b = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) if i % 2 else a[i][: i % 7] + a[i][i % 11 :] for i in range(150)]
        assert edit_distances(a, b).tolist() == [edit(x, y) for x, y in zip(a, b)]
    assert edit_distances([], []).tolist() == []
    long = "".join(r.choice("abcdefgh ") for _ in range(200_000))
    began = time.perf_counter()
    # a table of all pairs of characters would have 4 * 10 ** 10 cells
    assert edit_distances([long, long], [long[:50_000] + "x" + long[50_001:150_000] + long[150_002:], long]).tolist() == [3, 0]
    assert time.perf_counter() - began < 10
