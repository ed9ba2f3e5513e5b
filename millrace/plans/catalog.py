"""All queries over rendered legacy sources and over the driver's tables."""

from __future__ import annotations

from millrace.plans import cics, cobol, cobol_more, estate, estate_more
from millrace.registry import Registry

REGISTRY = Registry()
for part in (cics, cobol, cobol_more, estate, estate_more):
    REGISTRY.include(part.REGISTRY)
