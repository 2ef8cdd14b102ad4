"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP8_SQL, op8_chat_format
from .decontam import OP2_SQL, op2_decontamination
from .divergence import OP13_SQL, op13_source_divergence
from .langid import op9_language_id
from .media import op10_media
from .packing import op7_best_fit_packing
from .pii import op6_pii
from .quality import op3_quality
from .simhash import op1_simhash
from .suffix import op5_suffix_dedup
from .toxicity import op12_toxicity
from .vectorcodes import OP11_SQL, op11_vector_codes
from .wavelet import op4_wavelet_tokens

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_decontamination": op2_decontamination,
    "op3_quality": op3_quality,
    "op4_wavelet_tokens": op4_wavelet_tokens,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_pii": op6_pii,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_chat_format": op8_chat_format,
    "op9_language_id": op9_language_id,
    "op10_media": op10_media,
    "op11_vector_codes": op11_vector_codes,
    "op12_toxicity": op12_toxicity,
    "op13_source_divergence": op13_source_divergence,
}
SQL: dict[str, str] = {"op2_decontamination": OP2_SQL, "op8_chat_format": OP8_SQL, "op11_vector_codes": OP11_SQL, "op13_source_divergence": OP13_SQL}
