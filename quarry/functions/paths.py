"""Path expressions: basename, extension, binary suffix test, folder scope, glob matching."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import BINARY_SUFFIXES


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def basename(path) -> Column:
    """Text after the last ``/`` (the whole path when there is none)."""
    return F.regexp_extract(_c(path), r"([^/]*)\z", 1)


def extension(path) -> Column:
    """Lower-cased ``os.path.splitext`` extension of the basename, dot included.

    Leading dots do not start an extension (``.bashrc`` has none); ``a.`` has ``.``.
    """
    return F.regexp_extract(F.lower(basename(path)), r"(?s)^\.*[^.].*(\.[^.]*)\z", 1)


def extension_case_kept(path) -> Column:
    """As :func:`extension` but keeping the original case."""
    return F.regexp_extract(basename(path), r"(?s)^\.*[^.].*(\.[^.]*)\z", 1)


def raw_extension(path) -> Column:
    """Text after the last dot of the *whole* path, case kept ('' when no dot)."""
    p = _c(path)
    return F.when(F.instr(p, ".") > 0, F.regexp_extract(p, r"(?s)\.([^.]*)\z", 1)).otherwise(F.lit(""))


def binary_suffix_regex() -> str:
    return r"(?s)(" + "|".join(re.escape(s) for s in BINARY_SUFFIXES) + r")\z"


def is_binary(path) -> Column:
    """True when the lower-cased path ends with one of the binary suffixes."""
    return F.lower(_c(path)).rlike(binary_suffix_regex())


def in_folder(path, folder) -> Column:
    """``path == folder`` or ``path`` lies under ``folder/``; empty/null folder keeps all."""
    p, f = _c(path), _c(folder) if not isinstance(folder, str) else F.lit(folder)
    return (f.isNull() | (f == "") | (p == f) | p.startswith(F.concat(f, F.lit("/"))))


# ---------------------------------------------------------------- glob matching

MATCH_ALL = ("**/*", "*")


def normalise_glob(pattern: str) -> str | None:
    """Apply the double-star folding rules; ``None`` means "matches every path"."""
    if pattern in MATCH_ALL:
        return None
    return pattern.replace("**/*", "*").replace("**", "*")


def glob_to_regex(pattern: str) -> str:
    """Translate one shell glob to an anchored Java regex with fnmatch semantics.

    ``*`` matches any run of characters including ``/``; ``?`` one character;
    ``[...]`` a class (``[!...]`` negated); an unclosed ``[`` is literal. Case-sensitive.
    """
    norm = normalise_glob(pattern)
    if norm is None:
        return r"(?s)^.*\z"
    out, i, n = [], 0, len(norm)
    while i < n:
        ch = norm[i]
        i += 1
        if ch == "*":
            if not out or out[-1] != ".*":
                out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = i
            if j < n and norm[j] == "!":
                j += 1
            if j < n and norm[j] == "]":
                j += 1
            while j < n and norm[j] != "]":
                j += 1
            if j >= n:
                out.append(r"\[")
                continue
            body = norm[i:j]
            i = j + 1
            neg = body.startswith("!")
            if neg:
                body = body[1:]
            if not body:
                out.append("(?!)" if not neg else ".")
                continue
            cls = "".join("\\" + c if c in "\\[]&^-" and not (c == "-" and 0 < k < len(body) - 1)
                          else c for k, c in enumerate(body))
            out.append("[" + ("^" if neg else "") + cls + "]")
        else:
            out.append(re.escape(ch))
    return "(?s)^" + "".join(out) + r"\z"


def prefix_of_glob(pattern: str) -> str | None:
    """For ``dir/**/*``-style globs return the literal prefix ``dir/`` (pushes down to the scan)."""
    norm = normalise_glob(pattern)
    if norm is None:
        return ""
    if norm.endswith("/*") and not any(c in norm[:-1] for c in "*?["):
        return norm[:-1]
    return None


def glob_match(path, pattern: str) -> Column:
    """Predicate for one literal glob. Pure-prefix globs become ``startswith`` so that
    Catalyst can push a ``StringStartsWith`` filter into the parquet scan."""
    prefix = prefix_of_glob(pattern)
    p = _c(path)
    if prefix == "":
        return F.lit(True)
    if prefix is not None:
        return p.startswith(prefix)
    return p.rlike(glob_to_regex(pattern))


def glob_select(path, include: list[str] | None, exclude: list[str] | None) -> Column:
    """Any include glob matches and no exclude glob matches (include defaults to all)."""
    inc = [g for g in (include or []) if g and g.strip()] or ["**/*"]
    cond = None
    for g in inc:
        m = glob_match(path, g.strip())
        cond = m if cond is None else (cond | m)
    for g in exclude or []:
        if g and g.strip():
            cond = cond & ~glob_match(path, g.strip())
    return cond
