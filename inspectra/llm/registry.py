"""Registered queries of the corpus operators, with SQL twins where SQL can say it."""

from __future__ import annotations

from .decontaminate import OP4_SQL, op4_decontaminate
from .exact import OP5_SQL, op5_exact
from .jaccard import OP12_SQL, op12_jaccard
from .language import op8_language
from .mixture import OP3_SQL, op3_mixture
from .quality import op7_quality
from .repair import OP11_SQL, op11_repair
from .search import OP13_SQL, op13_search
from .simhash import op1_simhash
from .substring import OP2_SQL, op2_substring
from .suffixes import OP9_SQL, op9_suffixes
from .toxicity import op6_toxicity
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_substring": op2_substring,
    "op3_mixture": op3_mixture,
    "op4_decontaminate": op4_decontaminate,
    "op5_exact": op5_exact,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_suffixes": op9_suffixes,
    "op10_warc": op10_warc,
    "op11_repair": op11_repair,
    "op12_jaccard": op12_jaccard,
    "op13_search": op13_search,
}

ORACLE_SQL = {
    "op2_substring": OP2_SQL,
    "op3_mixture": OP3_SQL,
    "op4_decontaminate": OP4_SQL,
    "op5_exact": OP5_SQL,
    "op9_suffixes": OP9_SQL,
    "op10_warc": OP10_SQL,
    "op11_repair": OP11_SQL,
    "op12_jaccard": OP12_SQL,
    "op13_search": OP13_SQL,
}
