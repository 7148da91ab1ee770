"""The registered queries of this folder and their check SQL."""

from __future__ import annotations

from milaan.llm.op01_mix import ORACLE as MIX_SQL
from milaan.llm.op01_mix import op1_mix
from milaan.llm.op02_permutation import op2_permutation
from milaan.llm.op03_jaccard import op3_jaccard
from milaan.llm.op04_suffixes import op4_suffixes
from milaan.llm.op05_secrets import op5_secrets
from milaan.llm.op06_pii import op6_pii
from milaan.llm.op07_warc import ORACLE as WARC_SQL
from milaan.llm.op07_warc import op7_warc
from milaan.llm.op08_language import op8_language
from milaan.llm.op09_quality import op9_quality
from milaan.llm.op10_decontaminate import ORACLE as DECONTAMINATE_SQL
from milaan.llm.op10_decontaminate import op10_decontaminate
from milaan.llm.op11_spelling import ORACLE as SPELLING_SQL
from milaan.llm.op11_spelling import op11_spelling
from milaan.llm.op12_bottomk import op12_bottomk
from milaan.llm.op13_whitening import op13_whitening

QUERIES = {"op1_mix": op1_mix, "op2_permutation": op2_permutation, "op3_jaccard": op3_jaccard, "op4_suffixes": op4_suffixes, "op5_secrets": op5_secrets, "op6_pii": op6_pii, "op7_warc": op7_warc, "op8_language": op8_language, "op9_quality": op9_quality, "op10_decontaminate": op10_decontaminate, "op11_spelling": op11_spelling, "op12_bottomk": op12_bottomk, "op13_whitening": op13_whitening}
ORACLE_SQL = {"op1_mix": MIX_SQL, "op7_warc": WARC_SQL, "op10_decontaminate": DECONTAMINATE_SQL, "op11_spelling": SPELLING_SQL}
