"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, exact_dedup, fingerprint, fm_dedup, html_extract, itemsets, line_dedup, near_dedup, packing, prefix_trie, suffix_dedup, toxicity, warc


def queries() -> dict:
    return {
        "op1_fingerprint": fingerprint.op1_fingerprints,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_near_dedup": near_dedup.op5_near_dedup,
        "op6_packing": packing.op6_packing,
        "op7_substring_dedup": fm_dedup.op7_substring_dedup,
        "op8_decontamination": decontam.op8_decontamination,
        "op9_html_extract": html_extract.op9_html_extract,
        "op10_warc": warc.op10_warc,
        "op11_exact_dedup": exact_dedup.op11_exact_dedup,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_itemsets": itemsets.op13_itemsets,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.ORACLE_OP3,
        "op4_suffix_dedup": suffix_dedup.ORACLE_OP4,
        "op5_near_dedup": near_dedup.ORACLE_OP5,
        "op7_substring_dedup": fm_dedup.ORACLE_OP7,
        "op9_html_extract": html_extract.ORACLE_OP9,
        "op10_warc": warc.ORACLE_OP10,
        "op11_exact_dedup": exact_dedup.ORACLE_OP11,
        "op12_prefix_trie": prefix_trie.ORACLE_OP12,
        "op13_itemsets": itemsets.ORACLE_OP13,
    }
