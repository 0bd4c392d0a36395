"""Growing grids as streams."""

from .append import stream_appended

__all__ = ["stream_appended"]
