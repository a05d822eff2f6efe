"""All reference queries by name, with their SQL."""

from .queries import ORACLES, QUERIES

FLAGSHIP = "m1_feature_search"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
