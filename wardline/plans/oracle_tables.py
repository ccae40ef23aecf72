"""The derived governance tables as DuckDB common table expressions."""

from __future__ import annotations

import re

from wardline.sources.adapter import DERIVED, REFERENCE, required, translate

DUCKDB_DIALECT = {
    "$TS": "TIMESTAMP",
    "$LIST": "list_value",
    "$OBJ(": "struct_pack(objectName := ",
    "$SHAEND": ")",
    "$SHA(": "sha256(",
}


def with_tables(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` preceded by every derived table and ``extra`` expression it names."""
    extra = extra or {}
    bodies = {name: REFERENCE.sub(r"\1", translate(name, DUCKDB_DIALECT)) for name in DERIVED}
    order: list[str] = []

    def need(text: str, inside: tuple[str, ...] = ()) -> None:
        for name in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text)):
            if name in order or name in inside:
                continue
            if name in extra:
                need(extra[name], (*inside, name))
                order.append(name)
            elif name in bodies:
                order.extend(n for n in required(name) if n not in order)

    need(sql)
    tables = []
    for name in order:
        head = name
        body = extra.get(name, bodies.get(name))
        columns = re.match(r"\s*(\([^)]*\)) AS\s", body)
        if columns and name in extra:
            head, body = f"{name} {columns.group(1)}", body[columns.end():]
        tables.append(f"{head} AS ({body})")
    if not tables:
        return sql
    return "WITH RECURSIVE " + ",\n".join(tables) + "\n" + sql
