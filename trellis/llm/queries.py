"""The ten operators' queries and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from . import media, mixing, neighbours, passages, pieces, secrets, similar, tokenfile, toxicity, warc
from .sql import SQL  # noqa: F401

QUERIES = {
    "op1_token_files": tokenfile.op1_token_files,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_sampled_pieces": pieces.op3_sampled_pieces,
    "op4_repeated_passages": passages.op4_repeated_passages,
    "op5_nearest": neighbours.op5_nearest,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_media": media.op7_media,
    "op8_warc": warc.op8_warc,
    "op9_similar_documents": similar.op9_similar_documents,
    "op10_mix_sources": mixing.op10_mix_sources,
}
