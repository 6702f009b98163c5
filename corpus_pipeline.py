"""The corpus pipeline: its stages, how to run them, and SQL for its rows (none). The code is in ``gridloom.llm.pipeline``."""

from __future__ import annotations

from gridloom.llm.pipeline import ORACLE_SQL, STAGES, dedup, mix, pack, quality, run

__all__ = ["ORACLE_SQL", "STAGES", "dedup", "mix", "pack", "quality", "run"]
