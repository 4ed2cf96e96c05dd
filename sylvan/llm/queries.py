"""The driver's queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from sylvan.llm.fingerprint import op5_fingerprint
from sylvan.llm.license_scan import op7_license
from sylvan.llm.media import op1_matroska
from sylvan.llm.ngram_join import OP3_SQL, op3_ngram_jaccard
from sylvan.llm.packing import op4_packing
from sylvan.llm.pii import op10_pii
from sylvan.llm.secret_scan import op9_secrets
from sylvan.llm.sp_codec import op6_sentencepiece
from sylvan.llm.toxicity import op2_toxicity
from sylvan.llm.warc import OP8_SQL, op8_warc

QUERIES = {"op1_matroska": op1_matroska, "op2_toxicity": op2_toxicity, "op3_ngram_jaccard": op3_ngram_jaccard, "op4_packing": op4_packing, "op5_fingerprint": op5_fingerprint, "op6_sentencepiece": op6_sentencepiece, "op7_license": op7_license, "op8_warc": op8_warc, "op9_secrets": op9_secrets, "op10_pii": op10_pii}
ORACLE: dict[str, str] = {"op3_ngram_jaccard": OP3_SQL, "op8_warc": OP8_SQL}
