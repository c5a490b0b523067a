"""Registered queries: importing this package fills the registry."""

from tripweave.plans import q_reconcile, q_rules, q_samples, q_sources, q_streams, q_trips  # noqa: F401
from tripweave.plans.registry import ORACLES, QUERIES  # noqa: F401
