"""JSON-LD blocks of a page.  Depth is unbounded, so these run in Arrow batches."""

from __future__ import annotations

import json
import re

from . import vocabulary as v


def clean(value) -> str:
    return "" if value is None else re.sub(r"\s+", " ", str(value)).strip()


def flatten(payload) -> list[dict]:
    """All objects of lists and @graph members; members before their parent."""
    out, todo = [], [(payload, False)]
    while todo:
        item, opened = todo.pop()
        if isinstance(item, list):
            todo += [(x, False) for x in reversed(item)]
        elif isinstance(item, dict):
            graph = item.get("@graph")
            if opened or not isinstance(graph, list):
                out.append(item)
            else:
                todo.append((item, True))
                todo += [(x, False) for x in reversed(graph)]
    return out


def name_of(value) -> str:
    """A name: of an object, the first found in a list, or a string itself."""
    if isinstance(value, dict):
        return clean(value.get("name"))
    if isinstance(value, list):
        return next((n for n in map(name_of, value) if n), "")
    return clean(value) if isinstance(value, str) else ""


#: Result -> the keys that may hold it, best first.
_KEYS = {
    "title": ("title", "headline", "name"),
    "description": ("description",),
    "deadline": ("validThrough", "expires", "dateModified"),
    "organisation_name": ("hiringOrganization", "publisher", "author"),
}


def structured(scripts: list[str]) -> dict[str, str]:
    """title, description, deadline and organisation_name: the first non-empty of each."""
    found = dict.fromkeys(_KEYS, "")
    for script in scripts:
        try:
            payload = json.loads(script)
        except (ValueError, TypeError, RecursionError):
            continue
        for item in flatten(payload):
            kinds = item.get("@type", "")
            kinds = {str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])}
            if not kinds & set(v.SUPPORTED_JSON_TYPES):
                continue
            for key, names in _KEYS.items():
                if not found[key]:
                    value = next((item[n] for n in names if item.get(n)), None)
                    found[key] = name_of(value) if key == "organisation_name" else (clean(value) if value is not None else "")
    return found
