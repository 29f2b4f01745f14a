"""A session hook in an agent's settings file: put in once, taken out whole, the file otherwise left as it is."""

from __future__ import annotations

import json
import os
import shutil

EVENT = "SessionStart"
MARK = "capledger-session-check"


def _read(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    x = json.loads(text) if text.strip() else {}
    hooks = x.get("hooks", {}) if isinstance(x, dict) else None
    if not isinstance(hooks, dict) or not all(isinstance(v, list) for v in hooks.values()):
        raise ValueError(f"{path} isn't the settings file this expects; nothing was changed")
    return x


def _write(path: str, x: dict) -> None:
    """Beside the old file, which is kept as ``.bak``, then in its place."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    if os.path.exists(path):
        shutil.copy2(path, path + ".bak")
    with open(path + ".new", "w", encoding="utf-8") as f:
        f.write(json.dumps(x, indent=2, ensure_ascii=False) + "\n")
    os.replace(path + ".new", path)


def _ours(entry) -> bool:
    return MARK in json.dumps(entry)


def status(path: str) -> bool:
    """Whether the hook is in."""
    return any(_ours(e) for e in _read(path).get("hooks", {}).get(EVENT, []))


def install(path: str, command: str = "python -m capledger hook run") -> bool:
    """Put the hook in; False if it was. A file that isn't understood is an error, and stays."""
    x = _read(path)
    if status(path):
        return False
    x.setdefault("hooks", {}).setdefault(EVENT, []).append({"hooks": [{"type": "command", "command": f"{command} # {MARK}"}]})
    _write(path, x)
    return True


def uninstall(path: str) -> bool:
    """Take the hook out, and what it leaves empty; False if it wasn't in."""
    x = _read(path)
    if not status(path):
        return False
    left = [e for e in x["hooks"][EVENT] if not _ours(e)]
    x["hooks"].pop(EVENT) if not left else x["hooks"].update({EVENT: left})
    if not x["hooks"]:
        x.pop("hooks")
    _write(path, x)
    return True
