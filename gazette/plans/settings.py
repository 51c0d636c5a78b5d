"""What a run can be told from outside: the environment, or a .env file."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from gazette.sources.feeds import CATALOG


@dataclass(frozen=True)
class Settings:
    """A field is read from the variable of its name in upper case. Names are fixed values, and so are the numbers."""

    openrouter_api_key: str | None = None
    openrouter_model: str = "openai/gpt-oss-20b"
    openrouter_base_url: str = "https://openrouter.ai/api/v1"
    openrouter_site_url: str | None = None
    openrouter_app_name: str | None = "gazette"
    telegram_bot_token: str | None = None
    telegram_chat_id: str | None = None
    telegram_base_url: str = "https://api.telegram.org"
    telegram_parse_mode: str = "HTML"
    sources_file: str = str(CATALOG)
    request_timeout_seconds: int = 20
    http_concurrency: int = 8
    max_feed_items_per_source: int = 50
    max_articles_per_run: int = 50
    user_agent: str = "gazette/0.1"

    @classmethod
    def load(cls, env_file: str | Path = ".env", environ: Mapping[str, str] | None = None) -> Settings:
        """The environment counts before the file; names are matched in any case; unknown ones are left out."""
        said = {k.lower(): v for k, v in {**read_env(env_file), **(os.environ if environ is None else environ)}.items()}
        made = {f.name: said[f.name] for f in fields(cls) if f.name in said}
        for f in fields(cls):
            if f.name in made and isinstance(f.default, int):
                made[f.name] = int(made[f.name])
        return cls(**made)

    def missing(self, dry_run: bool) -> list[str]:
        """Variables that a real run can't do without and that are empty."""
        needed = () if dry_run else ("telegram_bot_token", "telegram_chat_id")
        return [name.upper() for name in needed if not (getattr(self, name) or "").strip()]

    def limit(self, asked: int | None) -> int:
        most = self.max_articles_per_run
        return max(1, min(most if asked is None else asked, most))


def read_env(path: str | Path) -> dict[str, str]:
    """NAME=value lines; quotes around a value go, and so do comments, blank lines and a leading `export`."""
    found: dict[str, str] = {}
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and not name.startswith("#"):
                value = value.strip()
                quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
                found[name.strip()] = value[1:-1] if quoted else value.partition(" #")[0].rstrip()
    return found
