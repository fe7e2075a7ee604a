"""Names of tables and views, and the text form of log positions."""

from __future__ import annotations

import re

_PART = re.compile(r'\s*(?:"((?:[^"]|"")+)"|([A-Za-z_][A-Za-z0-9_$]*))\s*(\.|$)')
DEFAULT_NAMESPACE = "public"


def parse_name(name: str, namespace: str = DEFAULT_NAMESPACE) -> tuple[str, str]:
    """(namespace, name). Unquoted parts fold to lower case, double-quoted ones stay as they are; at most two parts."""
    parts, at = [], 0
    while at < len(name) or not parts:
        m = _PART.match(name, at)
        if not m or (m[3] == "." and m.end() == len(name)):
            raise ValueError(f"{name!r} is not a valid name")
        parts.append(m[1].replace('""', '"') if m[1] is not None else m[2].lower())
        at = m.end()
    if len(parts) > 2:
        raise ValueError(f"{name!r} has more than two parts")
    return (parts[0], parts[1]) if len(parts) == 2 else (namespace, parts[0])


def quoted(part: str) -> str:
    return part if re.fullmatch(r"[a-z_][a-z0-9_$]*", part) else '"' + part.replace('"', '""') + '"'


def canonical(name: str, namespace: str = DEFAULT_NAMESPACE) -> str:
    """The stored form: with its namespace, quoted where needed only."""
    return ".".join(map(quoted, parse_name(name, namespace)))


def format_position(lsn: int) -> str:
    """64-bit position as two hexadecimal halves."""
    return f"{lsn >> 32:X}/{lsn & 0xFFFFFFFF:X}"


def parse_position(text: str | int) -> int:
    if isinstance(text, int):
        return text
    m = re.fullmatch(r"([0-9A-Fa-f]{1,8})/([0-9A-Fa-f]{1,8})", text)
    if not m:
        raise ValueError(f"{text!r} is not a log position")
    return int(m[1], 16) << 32 | int(m[2], 16)
