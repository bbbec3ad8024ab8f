"""All queries of the library proper and their SQL, by name."""

from __future__ import annotations

from scriptoria.operators import cleaning, learn, metrics, parsing, relational, textops

MODULES = (textops, cleaning, relational, metrics, learn, parsing)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
