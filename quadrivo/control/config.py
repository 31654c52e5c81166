"""Configuration from TOML: defaults, unknown keys refused, values checked."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo

from ..functions.instants import GRID_HOURS, HOUR, ZONE
from ..operators.queues import EXTRACTION_BUDGET, INGESTION_BUDGET
from ..operators.reminders import Rule, validate

SYNC, INGESTION, EXTRACTION, NOTIFICATIONS = JOBS = ("moodle_sync", "ingestion", "extraction", "notifications")
PIPELINE = (SYNC, INGESTION, EXTRACTION)


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Job:
    enabled: bool = True
    interval_hours: int | None = None
    max_items: int | None = None
    max_seconds: int | None = None


DEFAULTS = {SYNC: Job(interval_hours=6), INGESTION: Job(max_items=INGESTION_BUDGET, max_seconds=1800), EXTRACTION: Job(max_items=EXTRACTION_BUDGET, max_seconds=1800), NOTIFICATIONS: Job(interval_hours=1)}
RULES = tuple(Rule(f"{h}h", h * HOUR) for h in (24, 12, 6, 1))


@dataclass(frozen=True)
class Config:
    warehouse: str = "warehouse"
    timezone: str = ZONE
    retry_delay_seconds: float = 30
    allow_manual_disabled_jobs: bool = True
    jobs: Mapping[str, Job] = field(default_factory=lambda: dict(DEFAULTS))
    reminders: tuple[Rule, ...] = RULES

    def is_enabled(self, job: str) -> bool:
        return self.jobs[job].enabled

    @property
    def schedules(self) -> dict[str, int]:
        """Hours of each job that runs on the clock."""
        return {name: self.jobs[name].interval_hours for name in JOBS if self.jobs[name].interval_hours}


def _typed(where: str, value: object, kind: type, least: float | None = None) -> object:
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
        raise ConfigError(f"{where} must be of type {kind.__name__}")
    if least is not None and value < least:
        raise ConfigError(f"{where} must be at least {least}")
    return value


def _known(where: str, table: Mapping, keys: set[str]) -> None:
    if more := set(table) - keys:
        raise ConfigError(f"{where}: unknown key(s) {', '.join(sorted(more))}")


def parse(text: str) -> Config:
    try:
        table = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from None
    _known("the file", table, {"warehouse", "timezone", "retry_delay_seconds", "allow_manual_disabled_jobs", "reminders", *JOBS})
    jobs = {}
    for name in JOBS:
        own, base = table.get(name, {}), DEFAULTS[name]
        if not isinstance(own, dict):
            raise ConfigError(f"{name} must be a table")
        _known(name, own, {"enabled"} | ({"interval_hours"} if base.interval_hours else set()) | ({"max_items", "max_seconds"} if base.max_items else set()))
        made = {k: _typed(f"{name}.{k}", v, bool if k == "enabled" else int, None if k == "enabled" else 1) for k, v in own.items()}
        jobs[name] = Job(**(base.__dict__ | made))
        if jobs[name].interval_hours and jobs[name].interval_hours not in GRID_HOURS:
            raise ConfigError(f"{name}.interval_hours must be one of {GRID_HOURS}")
    rules = RULES
    if "reminders" in table:
        rules = tuple(_rule(i, r) for i, r in enumerate(_typed("reminders", table["reminders"], list)))
        validate(rules)
    zone = _typed("timezone", table.get("timezone", ZONE), str)
    try:
        ZoneInfo(zone)
    except Exception:
        raise ConfigError(f"timezone: no such zone: {zone}") from None
    base = Config()
    return Config(_typed("warehouse", table.get("warehouse", base.warehouse), str), zone, _typed("retry_delay_seconds", table.get("retry_delay_seconds", base.retry_delay_seconds), float, 0), _typed("allow_manual_disabled_jobs", table.get("allow_manual_disabled_jobs", True), bool), jobs, rules)


def _rule(i: int, table: object) -> Rule:
    if not isinstance(table, dict):
        raise ConfigError(f"reminders[{i}] must be a table")
    _known(f"reminders[{i}]", table, {"id", "hours_before", "title", "body"})
    for key, kind in (("id", str), ("hours_before", int)):
        if key not in table:
            raise ConfigError(f"reminders[{i}] needs {key}")
        _typed(f"reminders[{i}].{key}", table[key], kind)
    base = Rule(table["id"], table["hours_before"] * HOUR)
    return Rule(base.id, base.offset_seconds, table.get("title", base.title_template), table.get("body", base.body_template))
