"""Configuration: defaults, a JSON file merged over them, dot-path writes."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field
from pathlib import Path

# The defaults.
DEFAULTS = {
    "config_version": 1,
    "min_sessions": 3,
    "min_days": 2,
    "similarity": {"prompt_jaccard": 0.5, "tool_sequence": 0.6},
    "ignore_projects": [],
    "cross_project": False,
    "trivial": {"min_prompts": 1, "min_duration_seconds": 60},
    "publish": {"folder": None, "tags": []},
}
# End of fixed values.


def merged(base: dict, over) -> dict:
    """Objects merge key by key; anything else, arrays too, replaces."""
    if not isinstance(over, dict):
        return over
    out = dict(base) if isinstance(base, dict) else {}
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(out.get(k), dict) else v
    return out


def load(path: str | Path | None = None) -> dict:
    """Defaults under what the file holds; a file that can't be read or isn't an object leaves the defaults."""
    try:
        own = json.loads(Path(path).read_text("utf-8")) if path else {}
    except (OSError, ValueError):
        own = {}
    return merged(copy.deepcopy(DEFAULTS), own if isinstance(own, dict) else {})


def put(path: str | Path, dotted: str, raw: str) -> dict:
    """Set a key by its dotted path; the value is read as JSON, or else is text."""
    try:
        value = json.loads(raw)
    except ValueError:
        value = raw
    out = load(path)
    *above, last = dotted.split(".")
    node = out
    for k in above:
        if not isinstance(node.get(k), dict):
            node[k] = {}
        node = node[k]
    node[last] = value
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(out, indent=2) + "\n", "utf-8")
    return out


@dataclass(frozen=True)
class Rules:
    """The part of the configuration that plans use."""

    min_sessions: int = 3
    min_days: int = 2
    prompt_jaccard: float = 0.5
    tool_sequence: float = 0.6
    cross_project: bool = False
    ignore_projects: tuple[str, ...] = field(default=())
    min_prompts: int = 1
    min_duration_seconds: float = 60

    @staticmethod
    def of(config: dict) -> Rules:
        s, t = config["similarity"], config["trivial"]
        ignore = tuple(p for p in config.get("ignore_projects") or () if isinstance(p, str) and p)
        return Rules(config["min_sessions"], config["min_days"], s["prompt_jaccard"], s["tool_sequence"], bool(config["cross_project"]), ignore, t["min_prompts"], t["min_duration_seconds"])
