"""Tabular feature, model and monitoring operators on Spark."""

from .session import build_session

__all__ = ["build_session"]
