"""The corpus pipeline: its stages are in lamina.llm.pipeline."""

from lamina.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
