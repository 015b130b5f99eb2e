"""Web-readiness audit of crawled corpora, as Spark DataFrames."""

from sitegauge.plans.audit import audit, register_dimension, select_dimensions

__all__ = ["audit", "register_dimension", "select_dimensions"]
__version__ = "0.1.0"
