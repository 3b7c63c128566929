"""Every registered query and its SQL."""

from __future__ import annotations

from . import q_clean, q_evaluate, q_labels, q_models, q_prepare, q_profile, q_robust, q_runs, q_split  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
