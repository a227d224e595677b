"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from platwork.llm.byte_bpe import op8_byte_bpe
from platwork.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from platwork.llm.filter_audit import OP12_SQL, op12_filter_audit
from platwork.llm.jaccard import op9_jaccard
from platwork.llm.language_model import op10_language_model
from platwork.llm.license_scan import OP1_SQL, op1_license_scan
from platwork.llm.merkle import op13_merkle
from platwork.llm.packing import op7_packing
from platwork.llm.quality import op4_quality
from platwork.llm.topk import OP5_SQL, op5_topk
from platwork.llm.trie_bpe import op11_trie_bpe
from platwork.llm.url_filter import OP3_SQL, op3_url_filter
from platwork.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_warc": op2_warc,
    "op3_url_filter": op3_url_filter,
    "op4_quality": op4_quality,
    "op5_topk": op5_topk,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_jaccard": op9_jaccard,
    "op10_language_model": op10_language_model,
    "op11_trie_bpe": op11_trie_bpe,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle": op13_merkle,
}

ORACLES = {
    "op1_license_scan": OP1_SQL,
    "op5_topk": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op2_warc": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op12_filter_audit": OP12_SQL,
}
