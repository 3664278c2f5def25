"""Variable names as word grammars: domain[_test][_service][_age][_pop][_sector]."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

# Words of each slot of the grammar.
SLOTS = {
    "test": ("rdt", "mic"),
    "service": ("hf", "com", "hosp"),
    "age": ("u5", "ov5", "u1", "1_4", "5_14", "ov15"),
    "pop": ("preg", "nonpreg"),
    "sector": ("pub", "priv"),
}


@dataclass
class Parsed:
    name: str
    known: str | None = None
    domain: str | None = None
    parts: dict[str, str] = field(default_factory=dict)
    rest: list[str] = field(default_factory=list)


def leaves(tree: dict, name_key: str = "var_name", path: tuple[str, ...] = ()) -> Iterator[dict]:
    """Rows of a nested dictionary whose leaves hold a name under ``name_key``: the domain is the outermost key."""
    for key, node in tree.items():
        if isinstance(node, dict):
            if name_key in node:
                yield {"domain": path[0] if path else key, "path": "/".join((*path, key)), **{k: v for k, v in node.items() if not isinstance(v, dict)}}
            yield from leaves({k: v for k, v in node.items() if isinstance(v, dict)}, name_key, (*path, key))


def _near(a: str, b: str) -> bool:
    """Whether at most one letter is added, dropped or changed."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def parse_name(name: str, known: set[str], slots: dict[str, tuple[str, ...]] = SLOTS) -> Parsed:
    """Reads a name by the grammar and finds it among the known ones: as it is, then with one letter off, without case and underscores."""
    low = name.strip().lower()
    out = Parsed(name)
    if low in known:
        out.known = low
    else:
        flat = low.replace("_", "")
        out.known = min((k for k in known if _near(k.replace("_", "").lower(), flat)), default=None)
    text = re.sub(r"_(1_4|5_14)(?=_|$)", lambda m: "_" + m[1].replace("_", "-"), out.known or low)
    words = text.split("_")
    out.domain = words[0]
    order = list(slots)
    at = 0
    for w in words[1:]:
        w = w.replace("-", "_")
        slot = next((s for s in order[at:] if w in slots[s]), None)
        if slot is None:
            out.rest.append(w)
        else:
            out.parts[slot] = w
            at = order.index(slot) + 1
    return out
