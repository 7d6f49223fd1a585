"""The subpackage's registered queries and their DuckDB SQL."""

from __future__ import annotations

from . import bpe_codec, chat_format, collision_ann, delta_lloyd, language_crf, lexical_search, lz_fingerprint, passages, quality_neighbours, secret_scan, shingle_join, source_mix, token_count

QUERIES = {
    "op1_lz_fingerprint": lz_fingerprint.query,
    "op2_language_crf": language_crf.query,
    "op3_token_count": token_count.query,
    "op4_bpe_codec": bpe_codec.query,
    "op5_source_mix": source_mix.query,
    "op6_quality_neighbours": quality_neighbours.query,
    "op7_chat_format": chat_format.query,
    "op8_collision_ann": collision_ann.query,
    "op9_shingle_join": shingle_join.query,
    "op10_secret_scan": secret_scan.query,
    "op11_passage_dedup": passages.query,
    "op12_lexical_search": lexical_search.query,
    "op13_delta_lloyd": delta_lloyd.query,
}

#: Those that SQL can express; the others are tested against brute force, a round trip or held-out labels.
ORACLE_SQL = {
    "op5_source_mix": source_mix.ORACLE,
    "op7_chat_format": chat_format.ORACLE,
    "op9_shingle_join": shingle_join.ORACLE,
    "op10_secret_scan": secret_scan.ORACLE,
    "op11_passage_dedup": passages.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_delta_lloyd": delta_lloyd.ORACLE,
}
