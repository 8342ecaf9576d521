"""Explicit schemas: nothing is inferred."""

from __future__ import annotations

PAGES = "document_name string, page_number int, raw_text string, has_image boolean"
LINES = "array<struct<text:string,confidence:double>>"
CHUNKS = (
    "id string, filename string, document_name string, document_key string, chunk_index int, chunk_id string, page_number int, "
    "content_type string, extraction_method string, text string, ocr_confidence double"
)
SOURCE = "struct<text:string,filename:string,page_number:int,content_type:string,ocr_confidence:double>"
REJECTS = "path string, document_name string, error string"

DIGITAL = "digital_text"
HANDWRITTEN = "handwritten_ocr"
MIXED = "mixed"
