"""Readers, writers and date grids."""

from .grid import month_ends, quarter_ends
from .io import bulk, cache_key, compute_once, dedup_prices, parse_cached, read_csv, read_parquet, read_present, write_csv, write_json, write_parquet
from .shared import shared_dir
from .store import open_table, stored

__all__ = ["bulk", "cache_key", "compute_once", "dedup_prices", "month_ends", "open_table", "parse_cached", "quarter_ends", "read_csv", "read_parquet", "read_present", "shared_dir", "stored", "write_csv", "write_json", "write_parquet"]
