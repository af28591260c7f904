"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import sql
from .op1_packing import op1_packing
from .op2_bpe import op2_bpe
from .op3_shards import op3_shards
from .op4_near import op4_near
from .op5_audio import op5_audio
from .op6_urls import op6_urls
from .op7_repeats import op7_repeats
from .op8_secrets import op8_secrets
from .op9_lines import op9_lines
from .op10_quality import op10_quality

QUERIES = {f.__name__: f for f in (op1_packing, op2_bpe, op3_shards, op4_near, op5_audio, op6_urls, op7_repeats, op8_secrets, op9_lines, op10_quality)} | sql.PARTS

ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL
