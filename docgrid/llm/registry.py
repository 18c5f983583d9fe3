"""The queries of this subpackage and, where SQL can express them, their equivalents."""

from __future__ import annotations

from . import arc_converter, chat_trie, collocations, decontaminate, hilbert_shards, merkle_manifest, near_dups, quality_rules, secret_scan, sentencepiece_codec, token_planes, toxicity, url_filter

QUERIES = {
    "op1_hilbert_shards": hilbert_shards.op1_hilbert_shards,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_arc_to_warc": arc_converter.op4_arc_to_warc,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_chat_trie": chat_trie.op6_chat_trie,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_near_dups": near_dups.op9_near_dups,
    "op10_sentencepiece": sentencepiece_codec.op10_sentencepiece,
    "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
    "op12_token_planes": token_planes.op12_token_planes,
    "op13_collocations": collocations.op13_collocations,
}
ORACLE_SQL = {
    "op4_arc_to_warc": arc_converter.SQL,
    "op6_chat_trie": chat_trie.SQL,
    "op7_url_filter": url_filter.SQL,
    "op9_near_dups": near_dups.SQL,
    "op11_merkle_manifest": merkle_manifest.SQL,
    "op13_collocations": collocations.SQL,
}
