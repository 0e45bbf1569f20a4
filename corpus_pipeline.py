"""The corpus pipeline: its stages are in kairosight.llm.pipeline."""

from kairosight.llm.pipeline import NEAR, ORACLE_SQL, STAGES, run

__all__ = ["NEAR", "ORACLE_SQL", "STAGES", "run"]
