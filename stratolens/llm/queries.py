"""The registered queries of this subpackage and their SQL."""

from . import collocations, exact_dedup, language_id, licenses, media, mixing, ngram_join, packing, pii, quality, toxicity, warc, whitening

QUERIES = {
    "op1_mjpeg_avi": media.op1_mjpeg_avi,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_warc_chunks": warc.op5_warc_chunks,
    "op6_language_id": language_id.op6_language_id,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_personal_data": pii.op9_personal_data,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_phrase_collocations": collocations.op13_phrase_collocations,
}
ORACLE_SQL = {
    "op8_mix_sources": mixing.OP8_SQL,
    "op3_ngram_join": ngram_join.OP3_SQL,
    "op4_license_scan": licenses.OP4_SQL,
    "op5_warc_chunks": warc.OP5_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op13_phrase_collocations": collocations.OP13_SQL,
}
