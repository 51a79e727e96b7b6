"""Imports every query module, so that the registry is full."""

from evalweave.plans import (  # noqa: F401
    dataset_queries,
    run_queries,
    stream_queries,
    telemetry_queries,
)
from evalweave.plans.registry import BUILDERS, ORACLES

__all__ = ["BUILDERS", "ORACLES"]
