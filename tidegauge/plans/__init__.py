"""The registered queries of the log pipeline, and the DuckDB SQL that gives the same rows."""

from .oracles import ORACLES
from .queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
