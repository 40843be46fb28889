"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tallylog.llm.op1_quality import op1_quality
from tallylog.llm.op2_decontaminate import OP2_SQL, op2_decontaminate
from tallylog.llm.op3_pii import op3_pii
from tallylog.llm.op4_knn import OP4_SQL, op4_knn
from tallylog.llm.op5_simhash import op5_simhash
from tallylog.llm.op6_suffix import op6_suffix
from tallylog.llm.op7_html import op7_html
from tallylog.llm.op8_pieces import op8_pieces
from tallylog.llm.op9_lines import OP9_SQL, op9_lines
from tallylog.llm.op10_urls import op10_urls

QUERIES = {f.__name__: f for f in (op1_quality, op2_decontaminate, op3_pii, op4_knn, op5_simhash, op6_suffix, op7_html, op8_pieces, op9_lines, op10_urls)}
ORACLE = {"op2_decontaminate": OP2_SQL, "op4_knn": OP4_SQL, "op9_lines": OP9_SQL}
