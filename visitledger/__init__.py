"""Practice billing analytics on Spark: ingestion, merging and reports as lazy DataFrames."""

from visitledger.config import PracticeConfig

__all__ = ["PracticeConfig"]
