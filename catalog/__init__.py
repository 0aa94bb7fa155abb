"""The query catalog behind ``__spark_entry__``."""

from . import dataset_queries, feature_queries, model_queries, monitor_queries, run_queries, stream_queries
from .registry import ORACLE, QUERIES

__all__ = [
    "ORACLE", "QUERIES", "dataset_queries", "feature_queries", "model_queries", "monitor_queries", "run_queries",
    "stream_queries"]
