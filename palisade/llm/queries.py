"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from .bpe import op5_bpe
from .licenses import op8_licenses
from .media import op3_media
from .mixing import OP9_SQL, op9_mixing
from .oracle import ORACLE_SQL as MORE_SQL
from .pii import op7_pii
from .quality import op1_quality
from .rules import op6_rules
from .sharding import op4_sharding
from .simhash import op2_simhash
from .substring import op10_substring

QUERIES = {f.__name__: f for f in (op1_quality, op2_simhash, op3_media, op4_sharding, op5_bpe, op6_rules, op7_pii, op8_licenses, op9_mixing, op10_substring)}
ORACLE_SQL: dict[str, str] = {"op9_mixing": OP9_SQL} | MORE_SQL
