"""Settings of a run, read from a mapping such as the environment."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

#: Words for true and false.
TRUE_WORDS = ("1", "true", "yes", "on")
FALSE_WORDS = ("0", "false", "no", "off")


def text_setting(env: Mapping[str, str], name: str, default: str | None = None) -> str:
    """A blank value counts as missing; without a default that is an error."""
    value = env.get(name, "").strip()
    if value:
        return value
    if default is None:
        raise ValueError(f"{name} is not set")
    return default


def int_setting(env: Mapping[str, str], name: str, default: int | None = None) -> int:
    if name not in env and default is not None:
        return default
    return int(text_setting(env, name))


def bool_setting(env: Mapping[str, str], name: str, default: bool) -> bool:
    if name not in env:
        return default
    word = env[name].strip().lower()
    if word in TRUE_WORDS:
        return True
    if word in FALSE_WORDS:
        return False
    raise ValueError(f"{name} is neither true nor false: {env[name]!r}")


def path_setting(env: Mapping[str, str], name: str, default: Path) -> Path:
    return Path(env[name].strip()).expanduser() if name in env else default


@dataclass(frozen=True)
class SyncConfig:
    """What a run exports and where to."""

    export_json: bool = True
    export_text: bool = False
    json_dir: Path | None = None
    text_dir: Path | None = None
    download_attachments: bool = False
    state_dir: Path | None = None

    @classmethod
    def from_environment(cls, env: Mapping[str, str], root: Path) -> SyncConfig:
        """Settings by name; everything is exported, to folders below ``root``, unless a setting says otherwise."""
        as_json, as_text = bool_setting(env, "EXPORT_JSON", True), bool_setting(env, "EXPORT_TEXT", True)
        return cls(
            as_json, as_text,
            path_setting(env, "JSON_EXPORT_ROOT", root / "json") if as_json else None,
            path_setting(env, "TEXT_EXPORT_ROOT", root / "txt") if as_text else None,
            bool_setting(env, "DOWNLOAD_ATTACHMENTS", True), path_setting(env, "STATE_ROOT", root / "state"),
        )

    def __post_init__(self) -> None:
        problems = {
            "no export format is chosen": not (self.export_json or self.export_text),
            "JSON export needs a folder": self.export_json and self.json_dir is None,
            "text export needs a folder": self.export_text and self.text_dir is None,
            "attachments need the JSON export": self.download_attachments and not self.export_json,
        }
        for text, holds in problems.items():
            if holds:
                raise ValueError(text)


def configure_logging(logger: logging.Logger, folder: Path) -> None:
    """Everything to ``process.log`` in the folder, what matters to the console; earlier handlers are dropped."""
    logger.setLevel(logging.DEBUG)
    logger.handlers.clear()
    folder.mkdir(parents=True, exist_ok=True)
    for handler, level in ((logging.StreamHandler(), logging.INFO), (logging.FileHandler(folder / "process.log", encoding="utf-8"), logging.DEBUG)):
        handler.setLevel(level)
        handler.setFormatter(logging.Formatter("[%(asctime)s] %(levelname)s (%(name)s): %(message)s"))
        logger.addHandler(handler)
