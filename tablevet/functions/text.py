"""String predicates of the validity and standardization dimensions."""

from __future__ import annotations

from tablevet.functions.values import sql_text

# The patterns and tokens that decide which cells count as violations.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\n?\z"
PHONE_PATTERN = r"^[+\p{Nd}][\p{Nd}\s\p{Z}\-.()]{6,20}\n?\z"
FAKE_NULLS = ("n/a", "na", "null", "none", "-", "--", "unknown", "inconnu", "?", "nan", "nd")

# Every character Unicode counts as white space.
WHITESPACE_CODES = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
# Longest fake null is 7 characters; no character that lower-cases to one takes over 4 bytes.
_FAKE_NULL_MAX_BYTES = 32

_ESCAPED = [f"\\u{code:04x}" for code in WHITESPACE_CODES]
_WHITESPACE = "'" + "".join(_ESCAPED) + "'"
_WHITESPACE_LIST = ", ".join(f"'{e}'" for e in _ESCAPED)


def strip(c: str) -> str:
    """Drop white space of every kind at both ends (``trim`` alone drops spaces only)."""
    return f"trim(BOTH {_WHITESPACE} FROM {c})"


def folded(c: str) -> str:
    return f"lower({strip(c)})"


def is_padded(c: str) -> str:
    """``c <> strip(c)``, told from the two end characters: long texts are not copied."""
    return (
        f"(substring({c}, 1, 1) IN ({_WHITESPACE_LIST})"
        f" OR substring({c}, -1, 1) IN ({_WHITESPACE_LIST}))"
    )


def is_fake_null(c: str) -> str:
    """``folded(c)`` is a stand-in for null; only padded cells are stripped for it."""
    tokens = ", ".join(sql_text(t) for t in FAKE_NULLS)
    return (
        f"CASE WHEN {is_padded(c)} THEN {folded(c)} IN ({tokens})"
        f" WHEN octet_length({c}) <= {_FAKE_NULL_MAX_BYTES} THEN lower({c}) IN ({tokens})"
        " ELSE false END"
    )


def is_email(c: str) -> str:
    text = f"CAST({c} AS STRING)"
    # Most cells without an address are told apart before the pattern runs.
    return f"(contains({text}, '@') AND {text} RLIKE r'{EMAIL_PATTERN}')"


def is_phone(c: str) -> str:
    return f"CAST({c} AS STRING) RLIKE r'{PHONE_PATTERN}'"


def occurrences(c: str, character: str) -> str:
    return f"(length({c}) - length(replace({c}, {sql_text(character)}, '')))"
