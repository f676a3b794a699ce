"""Column names: standard forms, uniqueness and similarity."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from difflib import SequenceMatcher


def standardized(names: Sequence[str], remove_special: bool = True) -> list[str]:
    """Lower case, underscores for spaces, only ``a-z0-9_``, repeated names numbered."""
    result: list[str] = []
    seen: Counter[str] = Counter()
    for name in names:
        short = re.sub(r"\s+", "_", name.lower().strip())
        if remove_special:
            short = re.sub(r"[^a-z0-9_]", "", short)
        seen[short] += 1
        unique = short if seen[short] == 1 else f"{short}_{seen[short]}"
        while unique in result:
            seen[short] += 1
            unique = f"{short}_{seen[short]}"
        result.append(unique)
    return result


def snake_case(name: str) -> str:
    """``respondentID code`` as ``respondent_id_code``."""
    words = re.sub(r"[^0-9a-zA-Z]+", "_", str(name)).strip("_")
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", words).lower()


def deduplicated(names: Iterable[str]) -> list[str]:
    """Repeated names get ``_dup1``, ``_dup2`` and so on."""
    seen: Counter[str] = Counter()
    result = []
    for name in names:
        result.append(f"{name}_dup{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return result


def compact(name: str) -> str:
    """Lower case without underscores, hyphens and spaces."""
    return re.sub(r"[_\- ]", "", name.lower())


def loosely_equal(name: str, others: Iterable[str]) -> bool:
    """Whether the compact name equals, contains or lies in one of the others."""
    short = compact(name)
    return any(short in compact(o) or compact(o) in short for o in others)


def similarity(a: str | None, b: str | None) -> float:
    """Matching-block ratio of two names, ignoring case."""
    if not a or not b:
        return 0.0
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()
