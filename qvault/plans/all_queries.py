"""All registered queries of the engine's own operators."""

from qvault.plans import q_detectors, q_findings, q_integrity, q_inventory, q_rollups, q_scores, q_sources, q_threat  # noqa: F401
from qvault.plans.registry import ORACLES, QUERIES  # noqa: F401
