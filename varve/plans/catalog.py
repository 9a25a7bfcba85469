"""All registered queries by inventory id, and the SQL each must agree with."""

from __future__ import annotations

from varve.plans import catalog_models, catalog_prep, catalog_stats  # noqa: F401  (importing a part registers its queries)

QUERIES = dict(catalog_prep.Q)
ORACLES = dict(catalog_prep.O)
