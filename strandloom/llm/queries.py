"""The operators' registered queries and, where SQL can express them, the SQL each is held against."""

from __future__ import annotations

from strandloom.llm.bloom_lm import op11_log_frequency_bloom
from strandloom.llm.bpe import op10_byte_bpe
from strandloom.llm.decontamination import OP8_SQL, op8_contained_items
from strandloom.llm.importance import OP12_SQL, op12_aho_corasick_resampling
from strandloom.llm.lexical_search import OP13_SQL, op13_document_fp_tree
from strandloom.llm.line_dedup import OP4_SQL, op4_line_dedup
from strandloom.llm.minhash_dedup import OP2_SQL, op2_odd_sketches
from strandloom.llm.pii import op1_bilstm_crf
from strandloom.llm.posting_lists import op3_posting_lists
from strandloom.llm.quality import op9_byte_cnn
from strandloom.llm.secret_scan import OP6_SQL, op6_secret_scan
from strandloom.llm.sharding import op7_virtual_slots
from strandloom.llm.url_filter import OP5_SQL, op5_url_rules

QUERIES = {
    "op1_bilstm_crf": op1_bilstm_crf,
    "op2_odd_sketches": op2_odd_sketches,
    "op3_posting_lists": op3_posting_lists,
    "op4_line_dedup": op4_line_dedup,
    "op5_url_rules": op5_url_rules,
    "op6_secret_scan": op6_secret_scan,
    "op7_virtual_slots": op7_virtual_slots,
    "op8_contained_items": op8_contained_items,
    "op9_byte_cnn": op9_byte_cnn,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_log_frequency_bloom": op11_log_frequency_bloom,
    "op12_aho_corasick_resampling": op12_aho_corasick_resampling,
    "op13_document_fp_tree": op13_document_fp_tree,
}
ORACLES = {
    "op2_odd_sketches": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op5_url_rules": OP5_SQL,
    "op6_secret_scan": OP6_SQL,
    "op8_contained_items": OP8_SQL,
    "op12_aho_corasick_resampling": OP12_SQL,
    "op13_document_fp_tree": OP13_SQL,
}
