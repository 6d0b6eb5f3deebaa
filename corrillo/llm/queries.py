"""The queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from corrillo.llm.bpe import op6_byte_bpe
from corrillo.llm.chat import OP2_SQL, op2_snapshot_collapse
from corrillo.llm.classifier import op5_pairwise_ranking
from corrillo.llm.decontaminate import OP1_SQL, op1_positional_index
from corrillo.llm.minhash import op8_weighted_minhash
from corrillo.llm.quality import op3_compression_bands
from corrillo.llm.sharding import op9_bounded_ring
from corrillo.llm.suffix import op4_front_coded_sort
from corrillo.llm.urls import OP7_SQL, op7_temporal_list
from corrillo.llm.warc import OP10_SQL, op10_derivatives

QUERIES = {
    "op1_positional_index": op1_positional_index,
    "op2_snapshot_collapse": op2_snapshot_collapse,
    "op3_compression_bands": op3_compression_bands,
    "op4_front_coded_sort": op4_front_coded_sort,
    "op5_pairwise_ranking": op5_pairwise_ranking,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_temporal_list": op7_temporal_list,
    "op8_weighted_minhash": op8_weighted_minhash,
    "op9_bounded_ring": op9_bounded_ring,
    "op10_derivatives": op10_derivatives,
}

ORACLE_SQL: dict[str, str] = {
    "op1_positional_index": OP1_SQL,
    "op2_snapshot_collapse": OP2_SQL,
    "op7_temporal_list": OP7_SQL,
    "op10_derivatives": OP10_SQL,
}
