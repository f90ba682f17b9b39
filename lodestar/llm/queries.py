"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from lodestar.llm import chat, voronoi
from lodestar.llm.bpe import op3_bpe
from lodestar.llm.chat import op1_chat
from lodestar.llm.common import Query
from lodestar.llm.html_text import op7_html
from lodestar.llm.ivfpq import op5_ivfpq
from lodestar.llm.packing import op2_packing
from lodestar.llm.simhash import op10_simhash
from lodestar.llm.suffix_dedup import op6_suffix_dedup
from lodestar.llm.toxicity import op4_toxicity
from lodestar.llm.url_filter import op9_url_filter
from lodestar.llm.voronoi import op8_voronoi

QUERIES: dict[str, Query] = {
    "op1_chat": op1_chat,
    "op2_packing": op2_packing,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_ivfpq": op5_ivfpq,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_html": op7_html,
    "op8_voronoi": op8_voronoi,
    "op9_url_filter": op9_url_filter,
    "op10_simhash": op10_simhash,
}

ORACLE: dict[str, str] = {"op1_chat": chat.ORACLE_SQL, "op8_voronoi": voronoi.ORACLE_SQL}
