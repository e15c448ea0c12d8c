"""Catalog of the core queries and their SQL twins."""

from __future__ import annotations

from atrament.plans import audits, choices, corpora, integrity, layouts, scores  # noqa: F401
from atrament.plans.registry import QUERIES, SQL  # noqa: F401
