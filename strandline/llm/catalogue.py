"""Queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from strandline.llm import chat, exact_dedup, language, licenses, lines, near_dup, packing, pieces, quality, repair, urls, variants, warc

QUERIES = {
    "op1_language_mixture": language.op1_language_mixture,
    "op2_license_rules": licenses.op2_license_rules,
    "op3_minhash_neardup": near_dup.op3_minhash_neardup,
    "op4_line_quality": quality.op4_line_quality,
    "op5_piece_lattice": pieces.op5_piece_lattice,
    "op6_warc_round_trip": warc.op6_warc_round_trip,
    "op7_quote_links": chat.op7_quote_links,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_url_trees": urls.op9_url_trees,
    "op10_pack_windows": packing.op10_pack_windows,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_line_dedup": lines.op12_line_dedup,
    "op13_spelling_variants": variants.op13_spelling_variants,
}

ORACLE_SQL = {
    "op3_minhash_neardup": near_dup.OP3_SQL,
    "op4_line_quality": quality.OP4_SQL,
    "op6_warc_round_trip": warc.OP6_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op12_line_dedup": lines.OP12_SQL,
    "op13_spelling_variants": variants.OP13_SQL,
}
