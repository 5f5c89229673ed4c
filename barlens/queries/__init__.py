"""All registered queries; importing this package fills the registry."""

from barlens.queries.registry import ORACLES, QUERIES
from barlens.queries import bars_q, features_q, grid_q, factors_q, joins_q, labels_q, trades_q, mining_q, model_q, context_q, io_q  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
