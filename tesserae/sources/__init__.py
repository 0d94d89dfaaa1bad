"""Sources: tables by name, and the shared folder that intermediate tables go to."""

from tesserae.sources.tables import table

__all__ = ["table"]
