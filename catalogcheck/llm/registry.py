"""All queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from . import chat, ngram_join, packing, pieces, pii, ppm, quality, repeats, spelling, toxicity, urls, weighted, whitening

MODULES = (quality, toxicity, ngram_join, weighted, repeats, pieces, pii, chat, packing, urls, spelling, ppm, whitening)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
