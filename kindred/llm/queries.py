"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op10_encode_bpe
from .dedup import op3_near_duplicates
from .divergence import OP13_SQL, op13_source_divergence
from .fingerprints import op12_fingerprint_documents
from .hamming import OP9_SQL, op9_hamming_search
from .language import op7_identify_language
from .licenses import OP4_SQL, op4_scan_licenses
from .mixing import OP1_SQL, op1_mix_sources
from .neighbours import op2_nearest_neighbours
from .phrases import OP11_SQL, op11_mine_phrases
from .secrets import op6_scan_secrets
from .token_files import op8_token_files
from .toxicity import op5_score_toxicity


def queries() -> dict:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_nearest_neighbours": op2_nearest_neighbours,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_scan_licenses": op4_scan_licenses,
        "op5_score_toxicity": op5_score_toxicity,
        "op6_scan_secrets": op6_scan_secrets,
        "op7_identify_language": op7_identify_language,
        "op8_token_files": op8_token_files,
        "op9_hamming_search": op9_hamming_search,
        "op10_encode_bpe": op10_encode_bpe,
        "op11_mine_phrases": op11_mine_phrases,
        "op12_fingerprint_documents": op12_fingerprint_documents,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op4_scan_licenses": OP4_SQL, "op9_hamming_search": OP9_SQL, "op11_mine_phrases": OP11_SQL, "op13_source_divergence": OP13_SQL}
