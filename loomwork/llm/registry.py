"""The training-data queries: name -> Spark function, and DuckDB SQL where SQL can express the operator."""

from __future__ import annotations

from loomwork.llm import html_text, media, mixing, packing, phrases, pii, prefixes, quality, shards, simhash, sketches, token_files, tokens


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_flac_media": media.op2_flac_media,
        "op3_main_text": html_text.op3_main_text,
        "op4_fingerprints": sketches.op4_fingerprints,
        "op5_pseudonyms": pii.op5_pseudonyms,
        "op6_token_counts": tokens.op6_token_counts,
        "op7_token_files": token_files.op7_token_files,
        "op8_simhash_groups": simhash.op8_simhash_groups,
        "op9_quality": quality.op9_quality,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_phrases": phrases.op11_phrases,
        "op12_prefix_trie": prefixes.op12_prefix_trie,
        "op13_shards": shards.op13_shards,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.OP1_SQL, "op11_phrases": phrases.OP11_SQL, "op12_prefix_trie": prefixes.OP12_SQL, "op13_shards": shards.OP13_SQL}
