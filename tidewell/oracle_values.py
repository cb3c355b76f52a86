"""Plain data as VALUES lists, for DuckDB."""

from __future__ import annotations

from tidewell.sources.catalog import CatalogSpec


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int | float):
        return repr(v)
    if isinstance(v, list | tuple):
        return "[" + ", ".join(map(literal, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A WITH item of the rows; columns is a comma-separated list."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


def catalog(spec: CatalogSpec) -> str:
    """WITH items objects, cols, keys of a spec."""
    objects = [(t.ref, t.schema, t.name, t.kind, t.comment, float(t.row_estimate), t.excluded, ",".join(c.name for c in t.columns if c.is_pk)) for t in spec.tables]
    cols = [(t.ref, c.name, c.type, c.not_null, c.comment, k, c.is_pk) for t in spec.tables for k, c in enumerate(t.columns, 1)]
    keys = [(t.ref, k.name or f"{t.name}_{k.columns[0]}_fkey", k.columns[0], k.ref, k.ref_columns[0]) for t in spec.tables for k in t.foreign_keys]
    return ", ".join([values("objects", "ref, schema_name, name, kind, comment, row_estimate, excluded, pk", objects), values("cols", "ref, name, type, not_null, comment, ordinal, is_pk", cols), values("keys", "ref, name, col, ref_table, ref_col", keys)])


def tokens(text: str) -> str:
    """The token list of a text, by the rules of ``functions.text.tokenize``."""
    spaced = f"regexp_replace({text}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    spaced = f"regexp_replace(regexp_replace({spaced}, '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')"
    cut = f"string_split_regex(lower(regexp_replace({spaced}, '[^A-Za-z0-9]', ' ', 'g')), ' +')"
    kept = f"list_filter({cut}, lambda w: length(w) > 1 OR regexp_full_match(w, '[0-9]'))"
    from tidewell.functions.text import ABBREVIATIONS

    cases = " ".join(f"WHEN '{k}' THEN {literal(v)}" for k, v in ABBREVIATIONS.items())
    expanded = f"flatten(list_transform({kept}, lambda w: CASE w {cases} ELSE [w] END))"
    return f"list_transform({expanded}, lambda w: {stemmed('w')})"


def stemmed(w: str) -> str:
    return f"CASE WHEN {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y' WHEN {w} LIKE '%es' AND NOT regexp_matches({w}, '(ss|sh|ch)es$') THEN left({w}, length({w}) - 2) WHEN {w} LIKE '%s' AND NOT regexp_matches({w}, '(s|u|a)s$') THEN left({w}, length({w}) - 1) ELSE {w} END"
