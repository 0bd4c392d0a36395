"""Labelled N-dimensional arrays as tidy Spark DataFrames."""

from .api import explain_chunks, explain_interpolation, grid_schema, interpolate, iter_arrow, iter_batches, register, scan
from .plans.predicate import all_of, any_of, col, lit, sql, when

__all__ = ["all_of", "any_of", "col", "explain_chunks", "explain_interpolation", "grid_schema", "interpolate", "iter_arrow", "iter_batches", "lit", "register", "scan", "sql", "when"]
