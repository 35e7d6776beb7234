"""Cutting lineage: results written to the folder that all executors share."""

from ..functions.shared import drop_path, materialize, scratch

__all__ = ["drop_path", "materialize", "scratch"]
