"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm.brown_lm import op9_brown_lm
from tessera.llm.decontamination import OP5_SQL, op5_decontamination
from tessera.llm.host_rules import OP11_SQL, op11_host_rules
from tessera.llm.html_text import op6_html_text
from tessera.llm.language import op3_language_id
from tessera.llm.lexical import OP12_SQL, op12_lexical_search
from tessera.llm.neighbours import op10_neighbours
from tessera.llm.packing import op4_packing
from tessera.llm.sharding import op1_sharding
from tessera.llm.simhash import op7_simhash
from tessera.llm.toxicity import op2_toxicity
from tessera.llm.url_filter import OP8_SQL, op8_url_filters
from tessera.llm.whitening import op13_whitening

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_decontamination": op5_decontamination,
    "op6_html_text": op6_html_text,
    "op7_simhash": op7_simhash,
    "op8_url_filters": op8_url_filters,
    "op9_brown_lm": op9_brown_lm,
    "op10_neighbours": op10_neighbours,
    "op11_host_rules": op11_host_rules,
    "op12_lexical_search": op12_lexical_search,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op5_decontamination": OP5_SQL,
    "op8_url_filters": OP8_SQL,
    "op11_host_rules": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
}
