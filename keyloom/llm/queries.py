"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP6_SQL, op6_chat_format
from .decontamination import op7_decontamination
from .html import op9_html_text
from .packing import op10_packing
from .pii import op5_pii
from .quality import OP4_SQL, op4_quality_rules
from .simhash import op8_simhash
from .substrings import op2_repeated_substrings
from .toxicity import op3_toxicity
from .warc import OP1_SQL, op1_warc_fixity

QUERIES = {
    "op1_warc_fixity": op1_warc_fixity,
    "op2_repeated_substrings": op2_repeated_substrings,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii": op5_pii,
    "op6_chat_format": op6_chat_format,
    "op7_decontamination": op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_html_text": op9_html_text,
    "op10_packing": op10_packing,
}
ORACLES = {
    "op1_warc_fixity": OP1_SQL,
    "op4_quality_rules": OP4_SQL,
    "op6_chat_format": OP6_SQL,
}
