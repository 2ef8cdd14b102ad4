"""Settings that queries take as parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # fixed values: defaults of the service whose results these queries match
    min_extraction_chars: int = 500
    min_extraction_words: int = 500
    max_pdf_pages: int = 100
    pages_per_ocr_call: int = 14
    short_line_chars: int = 40
    chunk_mode: str = "semantic"
    chunk_size: int = 1500
    chunk_overlap_fraction: float = 0.2
    fixed_overlap_chars: int = 200
    use_global_outline: bool = False
    outline_min_chunks: int = 9
    outline_max_chunks: int = 10
    max_context_chunks: int = 15
    chunks_per_question: int = 3
    l2_top_k: int = 5
    batch_validation_max: int = 20
    default_target: int = 15
    max_target: int = 20
    extra_candidates: int = 2
    generation_attempts: int = 3
    base_timeout_s: int = 1200
    timeout_s_per_ten_chunks: int = 60
    stale_after_s: int = 1200
    progress_every_pages: int = 5
    style_cache_size: int = 20
    style_words: int = 400
    sampled_questions: int = 30
    prompt_chars: int = 120_000
    error_chars: int = 512
    rate_requests: int = 30
    rate_tokens: int = 25_000
    rate_window_s: int = 60


DEFAULT = Config()

#: Topics in their order, difficulties by rank, option labels, states.
TOPICS = [("polity", "Polity"), ("economy", "Economy"), ("history", "History"), ("geography", "Geography"), ("science", "Science"), ("environment", "Environment")]
DIFFICULTIES = ["medium", "easy", "hard"]
OPTION_LABELS = ["A", "B", "C", "D"]
ANSWER_LABELS = [*OPTION_LABELS, "E"]
RUNNING, TERMINAL = ["pending", "generating"], ["completed", "partial", "failed", "failed_timeout"]
#: Phrases of a critique that tell of a faulty key or explanation.
FAULTY_CRITIQUES = [
    "incorrect key",
    "key is wrong",
    "wrong key",
    "answer key is wrong",
    "correct option is wrong",
    "marked answer is incorrect",
    "explanation is wrong",
    "explanation is incorrect",
]
