"""The registered queries of this subpackage, and SQL that must give the same rows."""

from __future__ import annotations

from .compaction import OP7_SQL, op7_compaction
from .conversation_repair import OP13_SQL, op13_conversation_repair
from .decontamination import OP6_SQL, op6_decontamination
from .kneser_ney import op8_kneser_ney
from .matroska import op1_matroska
from .merkle import OP11_SQL, op11_merkle
from .packing import op12_packing
from .segment_sampling import op4_segment_sampling
from .simhash import op3_simhash
from .template_extraction import op5_template_extraction
from .toxicity import op2_toxicity
from .url_cascade import OP10_SQL, op10_url_cascade
from .warc_index import OP9_SQL, op9_warc

QUERIES = {
    "op1_matroska": op1_matroska,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_segment_sampling": op4_segment_sampling,
    "op5_template_extraction": op5_template_extraction,
    "op6_decontamination": op6_decontamination,
    "op7_compaction": op7_compaction,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_warc": op9_warc,
    "op10_url_cascade": op10_url_cascade,
    "op11_merkle": op11_merkle,
    "op12_packing": op12_packing,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {"op6_decontamination": OP6_SQL, "op7_compaction": OP7_SQL, "op9_warc": OP9_SQL, "op10_url_cascade": OP10_SQL, "op11_merkle": OP11_SQL, "op13_conversation_repair": OP13_SQL}
