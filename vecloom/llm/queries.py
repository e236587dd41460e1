"""Queries of this subpackage, one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from .langid import op2_langid
from .lm import op6_lm
from .merkle import op9_merkle
from .minhash import op4_minhash
from .mixing import op8_mixing
from .oracle import ORACLE_SQL  # noqa: F401
from .pieces import op7_pieces
from .quality import op3_quality
from .rules import op10_rules
from .substrings import op5_substrings
from .tokencount import op1_tokens

QUERIES = {
    "op1_tokens": op1_tokens,
    "op2_langid": op2_langid,
    "op3_quality": op3_quality,
    "op4_minhash": op4_minhash,
    "op5_substrings": op5_substrings,
    "op6_lm": op6_lm,
    "op7_pieces": op7_pieces,
    "op8_mixing": op8_mixing,
    "op9_merkle": op9_merkle,
    "op10_rules": op10_rules,
}
