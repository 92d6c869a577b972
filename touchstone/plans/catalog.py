"""All registered queries: importing this module fills the registry."""

from . import (  # noqa: F401
    manifest_queries,
    metric_queries,
    run_queries,
    scoring_queries,
    stream_queries,
    text_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
