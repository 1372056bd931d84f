"""Named queries over the sample tables, and the DuckDB SQL each is held against."""

from . import reports, screen, wide  # noqa: F401  (register their queries)
from .catalog import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
