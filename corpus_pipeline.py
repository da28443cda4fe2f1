"""The corpus pipeline. Its stages are described in lattica.llm.pipeline."""

from lattica.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
