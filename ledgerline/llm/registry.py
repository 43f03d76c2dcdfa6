"""Queries of this subpackage by name, and DuckDB statements for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline

from . import bpe, centroids, jaccard, leaks, licenses, mixing, pii, quality, repeats, resample, scoring, secrets, vectors


def queries() -> dict[str, Callable]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_leaks": leaks.op2_leaks,
        "op3_secrets": secrets.op3_secrets,
        "op4_scoring": scoring.op4_scoring,
        "op5_vectors": vectors.op5_vectors,
        "op6_quality": quality.op6_quality,
        "op7_repeats": repeats.op7_repeats,
        "op8_jaccard": jaccard.op8_jaccard,
        "op9_licenses": licenses.op9_licenses,
        "op10_bpe": bpe.op10_bpe,
        "op11_resample": resample.op11_resample,
        "op12_centroids": centroids.op12_centroids,
        "op13_mix": mixing.op13_mix,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    out = {"op9_licenses": licenses.op9_sql(), "op11_resample": resample.op11_sql(), "op12_centroids": centroids.op12_sql(), "op13_mix": mixing.op13_sql()}
    return out if corpus_pipeline.ORACLE_SQL is None else out | {"pipeline": corpus_pipeline.ORACLE_SQL}
