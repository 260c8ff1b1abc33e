"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm.bpe import op3_bpe
from tessera.llm.chat import op4_chat
from tessera.llm.collocations import op11_collocations
from tessera.llm.decontaminate import op7_decontaminate
from tessera.llm.fingerprints import op8_fingerprints
from tessera.llm.html import op2_html
from tessera.llm.jaccard import op10_jaccard
from tessera.llm.licenses import op12_licenses
from tessera.llm.oracles import ORACLES
from tessera.llm.quality import op1_quality
from tessera.llm.secrets import op6_secrets
from tessera.llm.sharding import op5_sharding
from tessera.llm.substrings import op9_substrings
from tessera.llm.whitening import op13_whitening

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_quality": op1_quality,
    "op2_html": op2_html,
    "op3_bpe": op3_bpe,
    "op4_chat": op4_chat,
    "op5_sharding": op5_sharding,
    "op6_secrets": op6_secrets,
    "op7_decontaminate": op7_decontaminate,
    "op8_fingerprints": op8_fingerprints,
    "op9_substrings": op9_substrings,
    "op10_jaccard": op10_jaccard,
    "op11_collocations": op11_collocations,
    "op12_licenses": op12_licenses,
    "op13_whitening": op13_whitening,
    "pipeline": corpus_pipeline.run,
}
