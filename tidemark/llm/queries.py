"""The registered queries of this subpackage and their SQL."""

from tidemark.llm.ctw import op1_lm_scoring
from tidemark.llm.extract import op10_html_text
from tidemark.llm.langid import op3_language_id
from tidemark.llm.lines import OP8_SQL, op8_line_dedup
from tidemark.llm.mixing import OP4_SQL, op4_mixing
from tidemark.llm.near import OP9_SQL, op9_near_dedup
from tidemark.llm.packing import op2_packing
from tidemark.llm.ptolemaic import OP11_SQL, op11_centroid_clustering
from tidemark.llm.quality import OP6_SQL, op6_quality_rules
from tidemark.llm.rans import op13_binary_output
from tidemark.llm.syncmers import op7_fingerprints
from tidemark.llm.warc import OP5_SQL, op5_warc
from tidemark.llm.whitening import op12_embedding_whitening

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_mixing": op4_mixing,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_fingerprints": op7_fingerprints,
    "op8_line_dedup": op8_line_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_html_text": op10_html_text,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_binary_output": op13_binary_output,
}

SQL = {
    "op4_mixing": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op6_quality_rules": OP6_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_near_dedup": OP9_SQL,
    "op11_centroid_clustering": OP11_SQL,
}
