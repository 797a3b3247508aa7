"""Every query of the panel library and its SQL."""

from __future__ import annotations

from . import q_core, q_panel, q_series  # noqa: F401
from .registry import QUERIES, SQL

flagship = q_core.flagship

__all__ = ["QUERIES", "SQL", "flagship"]
