"""The corpus pipeline, stage by stage."""

from gaugeworks.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
