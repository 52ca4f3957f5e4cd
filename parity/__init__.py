"""Queries on the supplied tables with the SQL that must give the same rows."""

from parity import (  # noqa: F401
    features,
    grid,
    incremental,
    modelling,
    payloads,
    quality,
    scoring,
    serving,
)
from parity.registry import CATALOG as ALL

__all__ = ["ALL"]
