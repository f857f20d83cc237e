"""The corpus pipeline, by its stages: see `sparrowmill.llm.pipeline`."""

from sparrowmill.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
