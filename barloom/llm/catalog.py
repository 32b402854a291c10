"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from barloom.llm import bpe, chat, clusters, embeddup, hardneg, mixing, neardup, pages, pii, quality, substrings, tokenfile, urls

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_urls": urls.op2_urls,
    "op3_bpe": bpe.op3_bpe,
    "op4_neardup": neardup.op4_neardup,
    "op5_chat": chat.op5_chat,
    "op6_tokenfile": tokenfile.op6_tokenfile,
    "op7_pii": pii.op7_pii,
    "op8_pages": pages.op8_pages,
    "op9_quality": quality.op9_quality,
    "op10_embeddings": embeddup.op10_embeddings,
    "op11_negatives": hardneg.op11_negatives,
    "op12_clusters": clusters.op12_clusters,
    "op13_substrings": substrings.op13_substrings,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op2_urls": urls.OP2_SQL,
    "op10_embeddings": embeddup.OP10_SQL,
    "op11_negatives": hardneg.OP11_SQL,
    "op12_clusters": clusters.OP12_SQL,
    "op13_substrings": substrings.OP13_SQL,
}
