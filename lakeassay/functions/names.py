"""What a column's name says about its role. Runs on names, never on rows."""

from __future__ import annotations

import re

from . import vocab as V


def tokens(name: str) -> list[str]:
    """Lower-case words of a snake, kebab, spaced, camel or Pascal case name."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", name.strip())
    return re.findall(r"[a-z0-9]+", spaced.lower()) if spaced.isascii() else [t for t in re.split(r"[^a-z0-9]+", spaced.lower()) if t]


def is_identifier(name: str) -> bool:
    t = set(tokens(name))
    numbered = t & {"no", "num", "number"} and "of" not in t
    return bool(t & V.STRONG_ID or ("key" in t and not t & V.KEY_MODIFIERS) or (("code" in t or numbered) and t & V.ENTITIES))


def is_lifecycle(name: str) -> bool:
    """Whether nulls are to be expected because most entities have not reached this milestone."""
    t = set(tokens(name))
    return bool(t & V.LIFECYCLE or (t & V.LIFECYCLE_ENDS and t & V.LIFECYCLE_DATES))


def has_any(name: str, words: set[str]) -> bool:
    return not words.isdisjoint(tokens(name))


def is_financial(name: str) -> bool:
    return any(p in name.lower() for p in V.FINANCIAL_PARTS)


def unique_names(names: list[str], blank: str = "col_{}") -> list[str]:
    """Non-empty names without repeats: the k-th repeat of a name gets ``_k``, and another number if that is taken."""
    out: list[str] = []
    given = {n.strip() for n in names}
    seen: dict[str, int] = {}
    for i, raw in enumerate(names):
        name = str(raw).strip() or blank.format(i + 1)
        if name in seen or name in out:
            k = seen.get(name, 0)
            while (new := f"{name}_{(k := k + 1)}") in out or new in given:
                pass
            seen[name], name = k, new
        else:
            seen[name] = 0
        out.append(name)
    return out
