"""All queries of the core operators, by name, and their SQL."""

from __future__ import annotations

from weftline.plans import batching, cleaning, corpora, language, scoring, storage

MODULES = (cleaning, corpora, language, scoring, batching, storage)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
