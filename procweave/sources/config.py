"""Settings of an analysis."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class AnalysisConfig:
    """Settings with their defaults; unknown keys are an error rather than ignored."""

    dialect: str = "tsql"
    mode: str = "documented"
    large_procedure_threshold: int = 2000
    chunk_size_tokens: int = 8000
    chunk_overlap_tokens: int = 500
    staging_prefix: str = "stg_"

    def with_values(self, values: dict) -> AnalysisConfig:
        known = {f.name for f in fields(self)}
        if unknown := sorted(set(values) - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return replace(self, **values)
