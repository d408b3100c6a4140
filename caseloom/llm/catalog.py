"""All queries of this subpackage and their SQL."""

from caseloom.llm import (  # noqa: F401
    chat_format,
    decontaminate,
    exact_dedup,
    language_id,
    lm_score,
    merkle_manifest,
    pack,
    periodic_runs,
    secret_scan,
    simhash_dedup,
    token_counts,
    toxicity,
    warc_normalise,
)
from caseloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
