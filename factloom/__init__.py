"""Claim verification as Spark jobs: table in, table out."""

from .session import spark_session

__all__ = ["spark_session"]
