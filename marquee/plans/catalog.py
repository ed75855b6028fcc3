"""Importing this module fills the registry."""

from marquee.plans import (  # noqa: F401
    analytics_queries, intake_queries, landing_queries, layer_queries, model_queries,
    profile_queries,
)
from marquee.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
