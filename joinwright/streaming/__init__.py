"""Incremental forms of the join summary."""

from .running import running_summary

__all__ = ["running_summary"]
