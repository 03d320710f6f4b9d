"""Queries and SQL of this package, for __spark_entry__."""

from __future__ import annotations

import corpus_pipeline

from . import crf_langid, html_extract, jaccard_join, line_spread, mih_search, ngram_lm, packing, poisson_mix, secret_scan, webp_media


def queries():
    return {
        "op1_ngram_lm": ngram_lm.op1_ngram_lm,
        "op2_poisson_mix": poisson_mix.op2_poisson_mix,
        "op3_line_spread": line_spread.op3_line_spread,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_html_extract": html_extract.op5_html_extract,
        "op6_crf_langid": crf_langid.op6_crf_langid,
        "op7_webp_media": webp_media.op7_webp_media,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_secret_scan": secret_scan.op9_secret_scan,
        "op10_mih_search": mih_search.op10_mih_search,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {"op2_poisson_mix": poisson_mix.SQL, "op3_line_spread": line_spread.SQL, "op8_jaccard_join": jaccard_join.SQL}
