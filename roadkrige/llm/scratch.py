"""Tables that cut lineage; see ``roadkrige.storage``."""

from __future__ import annotations

from ..storage import drop, folder, new_path, remove, table

__all__ = ["drop", "folder", "new_path", "remove", "table"]
