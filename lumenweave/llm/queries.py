"""Queries of this package's operators over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from .audit import op12_audit
from .centroids import op11_clusters
from .chat import linked_calls, op4_chat
from .decontaminate import op5_decontaminate
from .fingerprint import op1_fingerprint
from .license import op6_license
from .mixing import op10_mixing
from .ngrams import op8_ngrams
from .oracles import ORACLES  # noqa: F401
from .pieces import op13_pieces
from .pii import op2_pii
from .quality import op9_quality
from .simhash import op3_simhash
from .tokencount import op7_tokens

QUERIES = {f.__name__: f for f in (op1_fingerprint, op2_pii, op3_simhash, op4_chat, linked_calls, op5_decontaminate, op6_license, op7_tokens, op8_ngrams, op9_quality, op10_mixing, op11_clusters, op12_audit, op13_pieces)}
