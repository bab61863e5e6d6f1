"""Data profiling and fleet observability on Spark DataFrames."""

from .session import local_session

__all__ = ["local_session"]
