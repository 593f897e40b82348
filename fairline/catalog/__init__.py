"""All registered queries.  Importing this package fills the registry."""

from .registry import ORACLES, QUERIES

from . import evaluation, history, jobs, market, players, quality, resolution, sources, streams  # noqa: E402,F401

__all__ = ["ORACLES", "QUERIES"]
