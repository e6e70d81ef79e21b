"""The registered queries of this package and their SQL."""

from __future__ import annotations

from topotide.llm.alignment import op11_alignment
from topotide.llm.decontaminate import OP3_SQL, op3_decontaminate
from topotide.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from topotide.llm.mixing import op7_mixing
from topotide.llm.pii_crf import op1_pii
from topotide.llm.sharding import op10_sharding
from topotide.llm.simhash import op5_simhash
from topotide.llm.site_style_tree import op6_html_extraction
from topotide.llm.substring_dedup import op4_substring_dedup
from topotide.llm.token_output import op9_token_output
from topotide.llm.toxicity import op8_toxicity
from topotide.llm.whitening import op13_whitening
from topotide.llm.word_bpe import op12_word_bpe

QUERIES = {
    "op1_pii": op1_pii,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash": op5_simhash,
    "op6_html_extraction": op6_html_extraction,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_token_output": op9_token_output,
    "op10_sharding": op10_sharding,
    "op11_alignment": op11_alignment,
    "op12_word_bpe": op12_word_bpe,
    "op13_whitening": op13_whitening,
}
SQL = {"op2_exact_dedup": OP2_SQL, "op3_decontaminate": OP3_SQL}
