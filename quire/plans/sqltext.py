"""SQL fragments shared by the check queries (DuckDB dialect)."""

from __future__ import annotations

from quire.functions import text as T

NL = "chr(10)"
_WS_LITERAL = T.WS_CHARS.replace("'", "''")


def strip(x: str) -> str:
    return f"trim({x}, '{_WS_LITERAL}')"


def rstrip(x: str) -> str:
    return f"rtrim({x}, '{_WS_LITERAL}')"


def lstrip(x: str) -> str:
    return f"ltrim({x}, '{_WS_LITERAL}')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{T.WS}+', ' ', 'g')")


def canon(x: str) -> str:
    return f"lower({collapse(x)})"


def count_re(x: str, pat: str) -> str:
    return f"len(regexp_extract_all({x}, '{pat}'))"


def words(x: str) -> str:
    return f"CAST({count_re(x, T.WORD)} AS INTEGER)"


def kind(s: str) -> str:
    return f"""CASE WHEN {s} = '' THEN 'blank'
        WHEN regexp_matches({s}, '{T.HEADING}') THEN 'heading'
        WHEN regexp_matches({s}, '{T.BULLET}') THEN 'list_item'
        WHEN regexp_matches({s}, '{T.ORDERED}') THEN 'ordered_list_item'
        WHEN regexp_matches({s}, '{T.IMAGE}') THEN 'image'
        WHEN length({s}) - length(replace({s}, '|', '')) >= 2 THEN 'table_row'
        ELSE 'paragraph' END"""


def body(k: str, s: str) -> str:
    return f"""CASE {k}
        WHEN 'heading' THEN {strip(f"regexp_replace({s}, '{T.HEADING_MARK}', '')")}
        WHEN 'list_item' THEN {strip(f"regexp_replace({s}, '{T.BULLET_MARK}', '')")}
        WHEN 'ordered_list_item' THEN {strip(f"regexp_replace({s}, '{T.ORDERED_MARK}', '')")}
        WHEN 'image' THEN {strip(f"regexp_extract({s}, '{T.IMAGE}', 1)")}
        ELSE {s} END"""


def lines_of(src: str, key: str = "doc_id", text: str = "text") -> str:
    """One row per line: key, pos, raw, s (stripped)."""
    return f"""SELECT {key}, pos, raw, {strip('raw')} AS s FROM (
        SELECT {key}, unnest(range(len(parts))) AS pos, unnest(parts) AS raw FROM (
            SELECT {key}, CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts)-1] ELSE parts END AS parts
            FROM (SELECT {key}, regexp_split_to_array({text}, '{T.LINE_BREAK}') AS parts FROM {src})))"""


def round_half_up(x: str, digits: int = 2) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"
