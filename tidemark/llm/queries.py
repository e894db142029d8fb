"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from .chat import op7_chat
from .credentials import op13_secrets
from .dedup import OP5_SQL, op5_exact_dedup
from .html import op8_html
from .infill import OP12_SQL, op12_infill
from .jaccard import op4_ngram_jaccard
from .language import op10_language
from .manifest import OP11_SQL, op11_manifest
from .packing import op9_packing
from .pieces import op1_sentencepiece
from .quality import op6_quality
from .syncmers import op3_syncmers
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_warc": op2_warc,
    "op3_syncmers": op3_syncmers,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_chat": op7_chat,
    "op8_html": op8_html,
    "op9_packing": op9_packing,
    "op10_language": op10_language,
    "op11_manifest": op11_manifest,
    "op12_infill": op12_infill,
    "op13_secrets": op13_secrets,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op2_warc": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op11_manifest": OP11_SQL, "op12_infill": OP12_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
