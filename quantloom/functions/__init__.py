"""Column functions."""

from .numeric import clip, complete, nan_to_null, quoted, ratio, row_mean, row_weighted_mean, rounded

__all__ = ["clip", "complete", "nan_to_null", "quoted", "ratio", "row_mean", "row_weighted_mean", "rounded"]
