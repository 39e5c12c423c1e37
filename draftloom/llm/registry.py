"""The queries of this subpackage and their SQL, as __spark_entry__.py adds them."""

from __future__ import annotations

from .embedding_dedup import op3_embedding_dedup
from .language_id import op8_language_id
from .minhash_dedup import op10_minhash_dedup
from .mixing import ORACLE as MIXING_SQL
from .mixing import op5_mixing
from .packing import op6_packing
from .pii import op2_pii
from .quality_rules import ORACLE as QUALITY_SQL
from .quality_rules import op7_quality_rules
from .sharding import op9_sharding
from .toxicity import op1_toxicity
from .url_filter import ORACLE as URL_SQL
from .url_filter import op4_url_filter

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_sharding": op9_sharding,
    "op10_minhash_dedup": op10_minhash_dedup,
}

ORACLES: dict[str, str] = {
    "op4_url_filter": URL_SQL,
    "op5_mixing": MIXING_SQL,
    "op7_quality_rules": QUALITY_SQL,
}
