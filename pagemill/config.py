"""Settings that change results, in one frozen object handed to every operator."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 400
    chunk_overlap: int = 60
    embedded_min_chars: int = 20
    max_ocr_pages: int = 40
    printed_scan_ocr: bool = True
    min_confidence: float = 0.30
    recognizer_batch: int = 4
    pdf_max_dimension: int = 2000
    denoise_images: bool = False
    max_upload_mb: int = 100
    top_k: int = 6
    rerank_margin: float = 2.5
    rerank_candidates: int = 24
    rerank_candidates_max: int = 40
    overview_chunks: int = 10
    max_claims: int = 5
    rrf_k: int = 60
    data_dir: str = "data"

    @property
    def size(self) -> int:
        return max(400, self.chunk_size)

    @property
    def overlap(self) -> int:
        return max(0, min(self.chunk_overlap, self.size // 2))

    @property
    def max_upload_bytes(self) -> int:
        return self.max_upload_mb * 1024 * 1024

    @classmethod
    def from_environment(cls, prefix: str = "PAGEMILL_") -> Settings:
        """Defaults overridden by environment variables such as PAGEMILL_TOP_K."""
        found = {}
        for f in fields(cls):
            value = os.environ.get(prefix + f.name.upper())
            if value is not None:
                kind = type(f.default)
                found[f.name] = value.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(value)
        return cls(**found)


DEFAULT = Settings()
