"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``registered()`` and
``oracles()`` give the queries and the SQL that ``__spark_entry__`` adds when
this subpackage is there.
"""

from __future__ import annotations


def registered() -> dict:
    """Query name -> callable(spark, sf_dir)."""
    import corpus_pipeline

    from . import bestfit_pack, block_names, chat_tools, dart_minhash, huffman_ids, language_spans, mix_schedule, quality_votes, secret_links, suffix_windows

    return {
        "op1_suffix_array_dedup": suffix_windows.query,
        "op2_quality_rules": quality_votes.query,
        "op3_best_fit_packing": bestfit_pack.query,
        "op4_mix_sources": mix_schedule.query,
        "op5_chat_formatting": chat_tools.query,
        "op6_token_binary": huffman_ids.query,
        "op7_secret_scan": secret_links.query,
        "op8_language_id": language_spans.query,
        "op9_exact_dedup": block_names.query,
        "op10_dart_minhash": dart_minhash.query,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict:
    """Query name -> DuckDB SQL, where SQL can express the operator."""
    from . import block_names, chat_tools, dart_minhash, mix_schedule, suffix_windows

    return {
        "op1_suffix_array_dedup": suffix_windows.ORACLE_SQL,
        "op4_mix_sources": mix_schedule.ORACLE_SQL,
        "op5_chat_formatting": chat_tools.ORACLE_SQL,
        "op9_exact_dedup": block_names.ORACLE_SQL,
        "op10_dart_minhash": dart_minhash.ORACLE_SQL,
    }
