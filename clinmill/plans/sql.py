"""Pieces of SQL shared by the checks."""

_WS = r"[ \t\n\r\f\v]"


def collapsed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'))"


def stripped(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def fingerprint(c: str) -> str:
    return f"'cas_' || substr(sha1(substr({collapsed(c)}, 1, 200)), 1, 12)"


def folded(c: str) -> str:
    return f"strip_accents(lower(replace({c}, '’', '''')))"


def quotable(c: str) -> str:
    return f"trim(regexp_replace(replace(replace({folded(c)}, 'œ', 'oe'), 'æ', 'ae'), '[^a-z0-9]+', ' ', 'g'))"


def word_count(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '{_WS}+'), lambda w: w <> ''))"


def seeded(seed: int, *keys: str) -> str:
    return f"sha256('{seed}' || " + " || ".join(f"'-' || cast({k} as varchar)" for k in keys) + ")"


def case_id(text: str, key: str) -> str:
    return f"case when coalesce({stripped(text)}, '') <> '' then {fingerprint(text)} else 'sans_contexte_' || cast({key} as varchar) end"
