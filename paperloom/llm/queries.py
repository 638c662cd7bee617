"""Queries of this subpackage for the driver, and their SQL where there is one."""

from .embedding import op3_embedding_near_dedup
from .html_extract import op6_html_extraction
from .langid import op10_language_id
from .line_dedup import op9_line_dedup
from .lm_score import op4_lm_scoring
from .minhash import op2_minhash_near_dedup
from .mixing import op1_source_mixing
from .quality import op7_fertility_quality
from .token_counts import op5_token_counts
from .wfst import op8_sentencepiece

QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_minhash_near_dedup, op3_embedding_near_dedup, op4_lm_scoring, op5_token_counts, op6_html_extraction, op7_fertility_quality, op8_sentencepiece, op9_line_dedup, op10_language_id)}
#: None: each one's rows come from hashing, tokenisers, fitted models or graph search; tests/llm compares with brute force.
ORACLES: dict[str, str] = {}
