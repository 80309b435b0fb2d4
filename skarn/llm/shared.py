"""What the operators share of the engine: tables in the folder that all executors reach, and names of columns."""

from __future__ import annotations

from ..sources.scratch import fresh, new_path, quoted, released, remove, shared_dir, written

__all__ = ["fresh", "new_path", "quoted", "released", "remove", "shared_dir", "written"]
