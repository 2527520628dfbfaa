"""Many globs as few patterns whose cost doesn't grow with the globs.

Globs are sorted by where they are literal: at the start (``src/*``), at the end (``*.py``), in the
middle (``*test*``) or not at all. Each group is one trie of its literals, written as a regular
expression with shared beginnings: a matcher takes one branch per character, however many globs
there are. Globs literal at their end are matched on the reversed path.
"""

from __future__ import annotations

import re

from .paths import glob_to_regex, normalise_glob

_WILD = re.compile(r"[*?\[]")


class _Node:
    def __init__(self):
        self.next: dict[str, _Node] = {}
        self.tails: set[str] = set()

    def add(self, literal: str, tail: str) -> None:
        node = self
        for c in literal:
            node = node.next.setdefault(c, _Node())
        node.tails.add(tail)

    def regex(self) -> str:
        """Without recursion, so that literals may be of any length: children before parents."""
        order, at = [self], 0
        while at < len(order):
            order.extend(order[at].next.values())
            at += 1
        made: dict[int, str] = {}
        for node in reversed(order):
            if "" in node.tails:  # whatever follows is accepted
                made[id(node)] = ""
                continue
            parts = sorted(node.tails)
            parts += [re.escape(c) + made.pop(id(child)) for c, child in sorted(node.next.items())]
            made[id(node)] = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        return made[id(self)]


def _body(glob: str) -> str:
    """The glob's pattern, without the anchors."""
    return glob_to_regex(glob).removeprefix("(?s)^").removesuffix(r"\z")


def glob_set(globs: list[str] | None) -> dict[str, str | None]:
    """``all`` (a glob matches every path), and the patterns ``head``, ``tail`` (for the reversed
    path), ``inner`` and ``other``; a path is matched if one of them finds something in it. None
    for groups without globs."""
    head, tail, inner, other = _Node(), _Node(), _Node(), []
    found = {"all": False, "head": None, "tail": None, "inner": None, "other": None}
    n = dict.fromkeys(("head", "tail", "inner"), 0)
    for glob in globs if globs is not None else []:
        if glob is None or not glob.strip():
            continue
        norm = normalise_glob(glob.strip())
        if norm is None or set(norm) == {"*"}:
            return {**found, "all": True}
        first = _WILD.search(norm)
        if first is None:
            head.add(norm, r"\z")
            n["head"] += 1
            continue
        start = norm[:first.start()]
        bare = norm.strip("*")
        if not start and norm.startswith("*") and norm.endswith("*") and not _WILD.search(bare):
            inner.add(bare, "")
            n["inner"] += 1
            continue
        # The literal end, if the wildcard before it is a star (a class's end is not literal).
        star = norm.rfind("*")
        end = norm[star + 1:] if star >= 0 and not _WILD.search(norm[star + 1:]) and "]" not in norm[star + 1:] else ""
        if start and len(start) >= len(end):
            rest = norm[len(start):]
            head.add(start, "" if rest == "*" else _body(rest) + r"\z")
            n["head"] += 1
        elif end:
            rest = norm[:star + 1]
            if rest == "*":
                tail.add(end[::-1], "")
                n["tail"] += 1
            else:  # anchored at both ends: the end is checked by the pattern itself
                head.add(start, _body(norm[len(start):]) + r"\z") if start else other.append(_body(norm) + r"\z")
                n["head"] += bool(start)
        else:
            other.append(_body(norm) + r"\z")
    for name, node in (("head", head), ("tail", tail), ("inner", inner)):
        if n[name]:
            found[name] = ("(?s)" if name == "inner" else "(?s)^") + node.regex()
    if other:
        found["other"] = "(?s)^(?:" + "|".join(dict.fromkeys(other)) + ")"
    return found
