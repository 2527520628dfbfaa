"""Small DuckDB SQL fragments used by the oracles (independent of the Spark code paths)."""

from __future__ import annotations

from ..functions.constants import BINARY_SUFFIXES, CODE_EXTENSIONS, DOCUMENT_EXTENSIONS


def q(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def ext(path: str) -> str:
    return (f"regexp_extract(lower(regexp_extract({path}, '([^/]*)$', 1)), "
            r"'^\.*[^.].*(\.[^.]*)$', 1)")


def ftype(ext_sql: str) -> str:
    return (f"CASE WHEN {ext_sql} IN ({q(CODE_EXTENSIONS)}) THEN 'code' "
            f"WHEN {ext_sql} IN ({q(DOCUMENT_EXTENSIONS)}) THEN 'document' ELSE 'unknown' END")


def is_binary(path: str) -> str:
    alts = "|".join(s.replace(".", r"\.") for s in BINARY_SUFFIXES)
    return f"regexp_matches(lower({path}), '({alts})$')"
