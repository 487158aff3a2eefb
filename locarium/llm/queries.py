"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op5_bpe
from .embed_dedup import OP8_SQL, op8_embed_dedup
from .license_scan import op3_license_scan
from .minhash import OP7_SQL, op7_minhash
from .mixing import OP1_SQL, op1_mixing
from .pii import op2_pii
from .quality import op4_quality
from .secret_scan import op6_secret_scan
from .topk import OP9_SQL, op9_topk
from .toxicity import op10_toxicity

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_pii": op2_pii,
    "op3_license_scan": op3_license_scan,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_secret_scan": op6_secret_scan,
    "op7_minhash": op7_minhash,
    "op8_embed_dedup": op8_embed_dedup,
    "op9_topk": op9_topk,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {"op1_mixing": OP1_SQL, "op7_minhash": OP7_SQL, "op8_embed_dedup": OP8_SQL, "op9_topk": OP9_SQL}
