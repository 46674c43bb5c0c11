"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from gatelight.llm import ann, bpe, chat, decontam, jaccard, licenses, mixing, negatives, quality, rolling, substrings, toxicity, urls

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_url_filter": urls.op2_url_filter,
    "op3_preferences": chat.op3_preferences,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_quality": quality.op8_quality,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_nearest": ann.op10_nearest,
    "op11_rolling_median": rolling.op11_rolling_median,
    "op12_mixing": mixing.op12_mixing,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op1_license_scan": licenses.OP1_SQL,
    "op2_url_filter": urls.OP2_SQL,
    "op3_preferences": chat.OP3_SQL,
    "op5_substring_dedup": substrings.OP5_SQL,
    "op6_jaccard_join": jaccard.OP6_SQL,
    "op11_rolling_median": rolling.OP11_SQL,
    "op12_mixing": mixing.OP12_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}
