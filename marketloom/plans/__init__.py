"""All registered queries."""

from marketloom.plans import bundles, comparison, documents, extraction, market, providers, reports, research, scalars, streams  # noqa: F401
from marketloom.plans.registry import REGISTRY
from marketloom.plans.views import Views

__all__ = ["REGISTRY", "Views"]
