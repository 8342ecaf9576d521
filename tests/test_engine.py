import io
import zipfile

import numpy as np
import pytest

from pagemill import providers
from pagemill.config import Settings
from pagemill.operators import catalog
from pagemill.plans.engine import Engine
from pagemill.sources import ingest
from pagemill.sources.store import ChunkStore
from pagemill.streaming.ingest import stream_pages

POLICY = "1. Leave\nEmployees receive 25 days of paid leave each year. Requests go to the manager.\n2. Travel\nTravel is booked by the office. Receipts are due within 30 days.\n3. Hours\nOffice hours are nine to five. Late work needs consent.\n"


def docx(paragraphs, rows):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        f.writestr("word/document.xml", f"<w:document {w}><w:body>{p(paragraphs[0])}{table}{''.join(map(p, paragraphs[1:]))}</w:body></w:document>")
    return out.getvalue()


def test_docx_gives_paragraphs_then_table_rows():
    assert ingest.docx_text(docx(["one", " ", "two"], [["a", "b"], ["", "c"]])) == "one\ntwo\na b\nc"


class FakePdf:
    def __call__(self, content):
        if not content.startswith(b"%PDF"):
            raise ValueError("broken")
        return [(i, t, False) for i, t in enumerate(content.decode().split("\f")[1:], 1)]


def uploads(path):
    (path / "Policy.txt").write_bytes(POLICY.encode() * 3 + b"\xff\xfe caf\xc3\xa9")
    (path / "notes.docx").write_bytes(docx(["Rivers rise in spring and fall in autumn after dry weeks."], [["gauge", "42"]]))
    (path / "deck.pdf").write_bytes("%PDF\fCommon header\nThe first page speaks of water and of weirs.\fCommon header\nThe second page is about dams and sluices.\fCommon header of all pages".encode())
    (path / "bad.pdf").write_bytes(b"nothing")
    (path / "tool.exe").write_bytes(b"MZ")
    (path / "blank.md").write_bytes(b" \n")
    return str(path)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store") / "chunks"), pdf_pages=FakePdf(), embedder=providers.HashedEmbedder())
    e.results = e.ingest(uploads(tmp_path_factory.mktemp("uploads")))
    return e


def test_ingest_reports_and_rejects(engine):
    summary, rejects = engine.results
    got = {r["document_name"]: r for r in summary.collect()}
    assert set(got) == {"Policy.txt", "notes.docx", "deck.pdf"} | ({"blank.md"} & set(got))
    assert got["deck.pdf"]["page_count"] >= 2 and got["Policy.txt"]["methods"] == "plaintext" and got["notes.docx"]["methods"] == "python-docx"
    errors = {r["document_name"]: r["error"] for r in rejects.collect()}
    assert errors["tool.exe"] == "Unsupported file type: .exe" and errors["bad.pdf"].startswith("Could not open this PDF")
    assert errors["blank.md"] == "No readable text found in this document."
    names = {r["document_name"]: r["chunk_count"] for r in engine.list_documents().collect()}
    assert set(names) == {"Policy.txt", "notes.docx", "deck.pdf"} and engine.health()["documents"] == 3
    assert all("Common header" not in r["text"] for r in engine.store.chunks("DECK.pdf ").where("page_number < 3").collect())


def test_vectors_are_kept_once_and_die_with_their_chunks(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/store", embedder=providers.HashedEmbedder(16))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Rivers rise in spring. " * 40)
    engine.ingest(f"{tmp_path}/in")
    first = engine.store.vectors().count()
    (tmp_path / "in" / "a.txt").write_text("Dams hold water back.")
    engine.ingest(f"{tmp_path}/in")
    assert first > 1 and engine.store.vectors().count() == 1 == engine.store.chunks().count()
    norm = sum(x * x for x in engine.store.vectors().first()["embedding"])
    assert abs(norm - 1) < 1e-9
    engine.delete(["A.TXT"])
    assert engine.store.vectors().count() == 0 and engine.health()["documents"] == 0


def test_questions_stay_in_their_document(spark, engine):
    asked = spark.createDataFrame(
        [(1, "How many days of paid leave?", "policy.TXT"), (2, "Summarize this document", "deck.pdf"), (3, "paid leave days", "notes.docx"), (4, " ", "Policy.txt"), (5, "leave", "unknown.txt")],
        "query_id int, question string, document_name string",
    )
    got = {r["query_id"]: r for r in engine.ask(asked).collect()}
    assert len(got) == 5
    assert got[1]["reason"] is None and "25 days of paid leave" in got[1]["answer"] and got[1]["answer"].count("[S") >= 1
    assert {s["filename"] for s in got[1]["sources"]} == {"Policy.txt"}
    assert {s["filename"] for s in engine.evidence(asked).where("query_id = 2").first()["sources"]} == {"deck.pdf"}
    assert got[4]["reason"] == got[5]["reason"] == "no_evidence" and got[4]["sources"] == []
    assert "leave" not in " ".join(s["text"] for s in got[3]["sources"])


def test_store_replaces_deletes_and_compacts(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/log")
    assert store.chunks().count() == 0
    rows = lambda name, texts: spark.createDataFrame([(f"{name}{i}", name, name, name.lower(), i, f"0-{i}", None, "digital_text", "plaintext", t, None) for i, t in enumerate(texts)], ingest_schema())
    store.replace(rows("A.txt", ["one", "two"]).unionByName(rows("b.txt", ["three"])))
    store.replace(rows("A.txt", ["new"]))
    assert sorted(r["text"] for r in store.chunks().collect()) == ["new", "three"]
    store.delete([" a.TXT ", "unknown", ""])
    assert [r["text"] for r in store.chunks().collect()] == ["three"]
    store.replace(rows("A.txt", ["back"]))
    smaller = store.compact(f"{tmp_path}/small")
    assert sorted(r["text"] for r in smaller.chunks().collect()) == ["back", "three"] and smaller.log().count() == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"torn")
    with pytest.raises(Exception):  # noqa: B017
        ChunkStore(spark, f"{tmp_path}/bad").chunks().collect()


def ingest_schema():
    from pagemill.schemas import CHUNKS

    return CHUNKS


PAGE = "document_name string, page_number int, raw_text string, has_image boolean"


def streamed(spark, tmp_path, store, rows, **kw):
    spark.createDataFrame(rows, PAGE).write.mode("append").parquet(f"{tmp_path}/in")
    stream_pages(spark, f"{tmp_path}/in", store, f"{tmp_path}/mark", **kw).awaitTermination()


def texts(store):
    return sorted((r["document_name"], r["page_number"] or 0, r["chunk_index"], r["text"]) for r in store.chunks().collect())


def test_streamed_pages_replace_pages_and_keep_others(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/log")
    one, two = "the first page tells of leave and its requests", "the second page tells of travel and its receipts"
    streamed(spark, tmp_path, store, [("d.pdf", 1, "an old version of the first page of this", False)])
    streamed(spark, tmp_path, store, [("d.pdf", 1, one, False), ("e.pdf", 1, one, False)])
    streamed(spark, tmp_path, store, [("D.pdf ", 2, two, False)])
    assert texts(store) == [("D.pdf ", 1, 0, one), ("D.pdf ", 2, 1, two), ("e.pdf", 1, 0, one)]


def test_streamed_pages_are_routed_over_batches(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/log")
    body = "page {} has words of its own, enough of them to be read"
    streamed(spark, tmp_path, store, [("d.pdf", 1, f"Footer of the house\n{body.format('one')}", False), ("d.pdf", 3, "", True), (" ", 1, "x", None)])
    streamed(spark, tmp_path, store, [("d.pdf", 2, f"Footer of the house\n{body.format('two')}", False)])
    assert [t[3] for t in texts(store)] == [body.format("one"), body.format("two")]
    errors = {(r["document_name"], r["error"]) for r in store.rejects().collect()}
    assert errors == {("d.pdf", "page 3 needs recognition"), (" ", "page without a document name")}


def test_streamed_chunks_have_vectors_of_their_own_beside_uploads(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "d.txt").write_text("an uploaded text of many words")
    embedder = providers.HashedEmbedder()
    engine = Engine(spark, f"{tmp_path}/log", embedder=embedder)
    engine.ingest(f"{tmp_path}/files")
    new = "a streamed page with other words in it"
    streamed(spark, tmp_path, engine.store, [("d.txt", 1, new, False)], embedder=embedder)
    assert [t[3] for t in texts(engine.store)] == ["an uploaded text of many words", new]
    alone = Engine(spark, f"{tmp_path}/alone", embedder=embedder)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "n.txt").write_text(new)
    alone.ingest(f"{tmp_path}/other")
    want = alone.store.vectors().first()["embedding"]
    found = {r["chunk_index"]: r["embedding"] for r in engine.store.vectors().collect()}
    assert len(found) == 2 and found[1] == want and found[0] != want
    again = engine.store.compact(f"{tmp_path}/compact")
    assert texts(again) == texts(engine.store) and again.vectors().count() == 2


def test_streamed_pages_of_deleted_documents_stay_deleted(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/log")
    one, two = "the first page of a document with some words", "the second page of a document with some words"
    streamed(spark, tmp_path, store, [("d.pdf", 1, one, False)])
    store.delete(["d.pdf"])
    assert texts(store) == []
    streamed(spark, tmp_path, store, [("d.pdf", 2, two, False)])
    assert texts(store) == [("d.pdf", 2, 0, two)]


def test_usable_text_of_null_and_repeated_page_numbers(spark):
    from pagemill.operators import layout

    rows = [("d", None, "text without a number", False), ("d", 1, "one text", False), ("d", 1, "another text", False), ("d", 2, "same", False), ("d", 2, "same", False)]
    found = layout.usable_text(spark.createDataFrame(rows, PAGE)).collect()
    assert sorted((r["page_number"] or 0, r["raw_text"], r["usable_text"]) for r in found) == sorted((p or 0, t, t) for _, p, t, _ in rows)


class Broken:
    name = "broken"

    def load(self):
        return None

    def call(self, model, rows):
        raise RuntimeError("no model")


class Shout:
    name = "shout"

    def load(self):
        return None

    def call(self, model, rows):
        return ["PASS" if "good" in r["claim"] else "maybe" for r in rows]


def test_verifier_fails_closed(spark):
    claims = spark.createDataFrame([(0, "good a [S1]", ["x"]), (1, "good | b [S1]", ["x"]), (2, "bad [S1]", ["x"]), (7, "good late [S1]", ["x"])], "pos int, claim string, sources array<string>")
    assert [r["pos"] for r in providers.verified_claims(claims, Shout(), Settings()).collect()] == [0]
    assert providers.verified_claims(claims, Broken(), Settings()).count() == 0


def test_document_names_match_without_case(spark):
    df = spark.createDataFrame([("A.txt", "a.TXT", " a.txt "), ("A.txt", "b", "B "), ("a", "b", " "), ("a", None, None)], "f string, d string, w string")
    assert [r[0] for r in df.select(catalog.matches_document(df.f, df.d, df.w)).collect()] == [True, True, False, False]


def test_settings_from_environment(monkeypatch):
    monkeypatch.setenv("PAGEMILL_TOP_K", "3")
    monkeypatch.setenv("PAGEMILL_DENOISE_IMAGES", "yes")
    s = Settings.from_environment()
    assert s.top_k == 3 and s.denoise_images and s.max_upload_bytes == 100 * 1024 * 1024 and Settings(chunk_size=10).size == 400


class Ink:
    name = "ink"

    def load(self):
        return None

    def call(self, model, rows):
        return [{"text": f"## line of {r['height']}", "confidence": 0.9} for r in rows]


def drawn(lines, skew=0.0):
    page = np.full((700, 900), 255, np.uint8)
    for i in range(lines):
        x = np.arange(100, 800)
        y = (100 + 110 * i + np.tan(np.radians(skew)) * (x - 450)).astype(int)
        for d in range(24):
            page[y + d, x] = 30
    return page


def test_images_to_lines():
    from pagemill.operators import imaging

    for skew in (0.0, 4.0, -6.0):
        crops, angle = imaging.preprocess(drawn(4, skew))
        assert len(crops) == 4 and abs(angle - skew) < 0.6
    assert len(imaging.segment_lines(np.full((200, 200), 255, np.uint8))) == 1
    mask = np.zeros((60, 400), bool)
    mask[10:12] = True
    assert imaging.bands_of(mask) == []
    assert imaging.downscale(np.full((4000, 100), 7, np.uint8)).shape == (2000, 50)
    assert imaging.to_gray(np.full((2, 2, 3), 9, np.uint8)).tolist() == [[9, 9], [9, 9]]


def test_image_files_are_recognised(spark, tmp_path):
    import struct
    import zlib

    page = drawn(3)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in page)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 900, 700, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "scan.png").write_bytes(png)
    engine = Engine(spark, f"{tmp_path}/store", recogniser=Ink())
    summary, rejects = engine.ingest(f"{tmp_path}/in")
    row = summary.first()
    assert (row["content_type"], row["methods"], row["ocr_pages"], row["status"]) == ("handwritten_ocr", "trocr", 1, "INDEXED")
    chunk_row = engine.store.chunks().first()
    assert chunk_row["text"].count("line of") == 3 and "#" not in chunk_row["text"] and chunk_row["ocr_confidence"] == 0.9


def test_chat_endpoint(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, body):
            data = json.dumps(body).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self._reply({"models": [{"name": "small:latest"}]})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            user = asked["messages"][1]["content"]
            assert asked["options"]["temperature"] == 0 and not asked["stream"]
            self._reply({"message": {"content": ("PASS" if "sky" in user.split("CLAIM:")[1] else "Well, maybe") if "CLAIM:" in user else "The sky is blue [S1]"}})

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    chat = providers.ChatModel(f"http://127.0.0.1:{server.server_port}", "small")
    assert chat.ready() and not providers.ChatModel(chat.url, "other").ready() and not providers.ChatModel("http://127.0.0.1:9", "small").ready()
    with pytest.raises(RuntimeError, match="pull"):
        providers.ChatModel(chat.url, "other").require()
    source = [{"text": "The sky is blue.", "filename": "f", "page_number": 1, "content_type": "digital_text"}]
    rows = spark.createDataFrame([("why", source)], "question string, sources array<struct<text:string,filename:string,page_number:int,content_type:string>>")
    assert providers.apply(rows, providers.ChatGenerator(chat), ["question", "sources"], "draft", "string").first()["draft"] == "The sky is blue [S1]"
    claims = spark.createDataFrame([(0, "the sky [S1]", source), (1, "the sea [S1]", source)], "pos int, claim string, sources array<struct<text:string,filename:string,page_number:int,content_type:string>>")
    assert [r["pos"] for r in providers.verified_claims(claims, providers.ChatVerifier(chat), Settings()).collect()] == [0]
    server.shutdown()


class ScannedPdf:
    """Pages of '#' are scans of three dark lines, without an image if it is '#-'."""

    def __call__(self, content):
        paper = np.full((900, 700, 1), 255, np.uint8)
        for y in (100, 400, 700):
            paper[y : y + 60, 80:600] = 0
        for i, t in enumerate(content.decode().split("\f")[1:], 1):
            yield (i, "", True, paper if t == "#" else None) if t.startswith("#") else (i, t, False)


def test_scans_inside_pdfs_are_recognised_or_reported(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = [f"This page, numbered {i}, speaks of water and of weirs in some detail." for i in range(5)]
    (tmp_path / "in" / "mixed.pdf").write_bytes("\f".join(["%PDF", *text, *"####", "#-"]).encode())
    (tmp_path / "in" / "long.pdf").write_bytes("\f".join(["%PDF", *text, *"#" * 41]).encode())
    for name, recogniser, lost in (("a", None, range(6, 11)), ("b", Ink(), [10])):
        engine = Engine(spark, f"{tmp_path}/{name}", recogniser=recogniser, pdf_pages=ScannedPdf())
        summary, rejects = engine.ingest(f"{tmp_path}/in")
        errors = {(r["document_name"], r["error"]) for r in rejects.collect()}
        assert errors == {("mixed.pdf", f"page {n} needs recognition") for n in lost} | {("long.pdf", "more than 40 pages need recognition")}
        pages = {r["page_number"] for r in engine.store.chunks().where("filename = 'mixed.pdf'").collect()}
        assert pages == set(range(1, 11)) - set(lost)
