"""Connected components, from the engine."""

from __future__ import annotations

from ..operators.graph import components  # noqa: F401
