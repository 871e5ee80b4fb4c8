"""Readers and writers."""

from .fixed import read_fixed, write_fixed
from .tables import read_table
from .tbl import LINEITEM, PART, TBL_ROWS, read_tbl, write_tbl

__all__ = ["LINEITEM", "PART", "TBL_ROWS", "read_fixed", "read_table", "read_tbl", "write_fixed", "write_tbl"]
