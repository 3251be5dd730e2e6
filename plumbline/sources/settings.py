"""Settings from TOML and the environment."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field
from typing import Any

PREFIX = "PLUMBLINE_"
# Environment variables that warehouses' own tools read.
VENDOR = {
    "bigquery": {"project_id": "GOOGLE_CLOUD_PROJECT", "credentials": "GOOGLE_APPLICATION_CREDENTIALS"},
    "snowflake": {"account": "SNOWFLAKE_ACCOUNT", "username": "SNOWFLAKE_USER", "password": "SNOWFLAKE_PASSWORD", "warehouse": "SNOWFLAKE_WAREHOUSE", "role": "SNOWFLAKE_ROLE", "database": "SNOWFLAKE_DATABASE"},
    "postgres": {"host": "PGHOST", "port": "PGPORT", "database": "PGDATABASE", "user": "PGUSER", "password": "PGPASSWORD"},
}
VENDOR["redshift"] = VENDOR["postgres"]


@dataclass
class Settings:
    dialect: str = "ansi"
    redact: bool = False
    severity: dict[str, str] = field(default_factory=dict)
    skip_models: list[str] = field(default_factory=list)
    allow_widening: list[str] = field(default_factory=list)
    allow_extra_columns: list[str] = field(default_factory=list)
    warehouse_type: str | None = None
    warehouse: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Settings:
        raw = tomllib.loads(text)
        allow, house = raw.get("allowlist", {}), raw.get("warehouse", {})
        overrides = raw.get("severity", {})
        return cls(
            dialect=raw.get("dialect", "ansi"),
            redact=bool(raw.get("redact", False)),
            severity={k.upper(): v for k, v in overrides.get("overrides", overrides).items()},
            skip_models=list(allow.get("skip_models", [])),
            allow_widening=list(allow.get("allow_widening", [])),
            allow_extra_columns=list(allow.get("allow_extra_columns", [])),
            warehouse_type=house.get("type"),
            warehouse=dict(house.get("settings", {})),
        )

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read())

    def dump(self) -> str:
        show = lambda v: json.dumps(v)  # noqa: E731  TOML's strings, booleans and lists of them are JSON's
        x = asdict(self)
        lines = [f"dialect = {show(self.dialect)}", f"redact = {show(self.redact)}", "", "[severity.overrides]"]
        lines += [f"{k} = {show(v)}" for k, v in self.severity.items()]
        lines += ["", "[allowlist]", *[f"{k} = {show(x[k])}" for k in ("skip_models", "allow_widening", "allow_extra_columns")]]
        if self.warehouse_type:
            lines += ["", "[warehouse]", f"type = {show(self.warehouse_type)}", "", "[warehouse.settings]", *[f"{k} = {show(v)}" for k, v in self.warehouse.items()]]
        return "\n".join(lines) + "\n"

    def setting(self, name: str, env: dict[str, str] | None = None) -> Any:
        """Our own variable first, then the vendor's, then the file."""
        env = os.environ if env is None else env
        own = f"{PREFIX}{(self.warehouse_type or '').upper()}_{name.upper()}"
        vendor = VENDOR.get(self.warehouse_type or "", {}).get(name)
        return env.get(own) or (vendor and env.get(vendor)) or self.warehouse.get(name)
