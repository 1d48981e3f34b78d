"""Suppression rules: a TOML file beside the references, or above them up to the repository's root."""

from __future__ import annotations

import tomllib
from pathlib import Path

CONFIG = ".citeledger.toml"
_KEYS = ("key", "field", "kind", "reason")


class RuleError(ValueError):
    """The rules file can't be used."""


def parse_rules(text: str, where: str = CONFIG) -> list[tuple[str, str, str, str]]:
    """(key, field, kind, reason) of each [[ignore]] table, in order; globs default to any, a reason is due."""
    try:
        entries = tomllib.loads(text).get("ignore", [])
    except tomllib.TOMLDecodeError as bad:
        raise RuleError(f"{where}: {bad}") from bad
    if not isinstance(entries, list):
        raise RuleError(f"{where}: write rules as [[ignore]] tables, not as {type(entries).__name__}")
    rules = []
    for n, entry in enumerate(entries, 1):
        if not isinstance(entry, dict):
            raise RuleError(f"{where}: rule {n} is no table")
        if unknown := sorted(entry.keys() - set(_KEYS)):
            raise RuleError(f"{where}: rule {n} has unknown keys: {', '.join(unknown)} (known: {', '.join(sorted(_KEYS))})")
        reason = str(entry.get("reason", "")).strip()
        if not reason:
            raise RuleError(f"{where}: rule {n} gives no reason")
        rules.append((*(str(entry.get(k, "*")) for k in _KEYS[:3]), reason))
    return rules


def load_rules(start: Path) -> tuple[list[tuple[str, str, str, str]], Path | None]:
    """(rules, their file), looked for from start upwards and no further than a repository's root."""
    folder = start if start.is_dir() else start.parent
    for at in (folder, *folder.parents):
        if (at / CONFIG).is_file():
            try:
                return parse_rules((at / CONFIG).read_text("utf-8"), str(at / CONFIG)), at / CONFIG
            except UnicodeDecodeError as bad:
                raise RuleError(f"{at / CONFIG}: not UTF-8 ({bad})") from bad
            except OSError as bad:
                raise RuleError(f"{at / CONFIG}: can't be read ({bad})") from bad
        if (at / ".git").exists():
            break
    return [], None
