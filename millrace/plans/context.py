"""Run context: what a transform may know about the run it belongs to."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from millrace.functions.templating import DEFAULT_FORMAT, date_range, date_variables, replace_names
from millrace.functions.tokens import namespace_name


@dataclass(frozen=True)
class RunContext:
    """Business date, application and namespace of a run."""

    business_date: str | None = None
    date_mode: str = "single"
    date_format: str = DEFAULT_FORMAT
    range_from: str | None = None
    range_to: str | None = None
    app_id: str | None = None
    app_name: str | None = None
    namespace_prefix: str | None = None
    db_name: str | None = None
    run_id: int | str | None = None
    pipeline_id: int | str | None = None

    @property
    def namespace(self) -> str | None:
        return namespace_name(self.business_date, self.namespace_prefix, self.db_name)

    @property
    def bounds(self) -> tuple[dt.date, dt.date] | None:
        if not self.business_date:
            return None
        ends = [dt.date.fromisoformat(t) if t else None for t in (self.range_from, self.range_to)]
        return date_range(dt.date.fromisoformat(self.business_date), self.date_mode, *ends)

    def variables(self) -> dict[str, str]:
        return date_variables(
            self.business_date,
            self.date_format,
            self.date_mode,
            self.range_from,
            self.range_to,
            self.app_id,
            self.app_name,
        )

    def render(self, text: str) -> str:
        """Text with this run's ``$names`` replaced."""
        return replace_names(text, self.variables())

    def runtime(self) -> dict:
        """The values a callable transform sees."""
        first, last = self.bounds or (None, None)
        return {
            "business_date": self.business_date,
            "business_date_from": first.isoformat() if first else None,
            "business_date_to": last.isoformat() if last else None,
            "app_id": self.app_id,
            "app_name": self.app_name,
            "namespace_db": self.namespace,
            "run_id": self.run_id,
            "pipeline_id": self.pipeline_id,
        }
