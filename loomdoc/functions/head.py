"""Page heads: the part of YAML that they use, read into nested values.

Maps and lists nest by indentation, a list may stand at its key's own indentation, and its items may be maps. Scalars are plain
(null, booleans, numbers, else text), in single or double quotes, lists in brackets, or blocks (``|`` and ``>``). A key that
comes twice, a line that is none of these, and indentation that fits no open level are errors with the line's number.
"""

from __future__ import annotations

import json
import re
from typing import Any

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'[^']*'|[^\s:"'#\[\]{}-][^:]*?)\s*:(?:\s+(.*))?$""")
_NUMBER = re.compile(r"[-+]?(?:\d+|\d*\.\d+(?:[eE][-+]?\d+)?)")
_WORDS = {"": None, "~": None, "null": None, "true": True, "false": False}


class HeadError(ValueError):
    """A head that cannot be read; its text is the place."""


def quoted(text: str) -> tuple[str, str]:
    """The value of a string in quotes at the start of ``text``, and what stands behind it."""
    if text[0] == '"':
        m = re.match(r'"((?:[^"\\]|\\.)*)"', text)
        return (json.loads(m[0]) if m else "", text[m.end() :] if m else "\0")
    m = re.match(r"'((?:[^']|'')*)'", text)
    return (m[1].replace("''", "'") if m else "", text[m.end() :] if m else "\0")


def scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in ("'", '"'):
        value, rest = quoted(text)
        if rest.strip() and not rest.lstrip().startswith("#"):
            raise HeadError("quotes")
        return value
    text = re.split(r"\s#", text, maxsplit=1)[0].rstrip()
    if text.startswith("["):
        return flow_list(text)
    if text == "{}":
        return {}
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    if _NUMBER.fullmatch(text):
        return float(text) if "." in text or "e" in text.lower() else int(text)
    if text[:1] in ("{", "&", "*", "!", "%", "@", "`", "|", ">"):
        raise HeadError("value")
    return text


def flow_list(text: str) -> list[Any]:
    if not text.endswith("]"):
        raise HeadError("list")
    parts = re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+)\s*(?:,|$)""", text[1:-1])
    return [scalar(p) for p in parts]


class HeadReader:
    def __init__(self, text: str):
        self.lines, self.at = text.split("\n"), 0

    def read(self) -> dict[str, Any]:
        try:
            found = self.mapping(0) if self.peek() is not None else {}
            if self.peek() is not None:
                raise HeadError("indentation")
            return found
        except (HeadError, json.JSONDecodeError) as e:
            what = e.args[0] if isinstance(e, HeadError) else "quotes"
            raise HeadError(f"line {min(self.at, len(self.lines) - 1) + 1}: {what}") from None

    def peek(self) -> int | None:
        """The indentation of the next line with content."""
        while self.at < len(self.lines):
            bare = self.lines[self.at].strip()
            if bare and not bare.startswith("#"):
                return len(self.lines[self.at]) - len(self.lines[self.at].lstrip(" "))
            self.at += 1
        return None

    def is_item(self) -> bool:
        return re.match(r"\s*-(\s|$)", self.lines[self.at]) is not None

    def value(self, indent: int) -> Any:
        return self.sequence(indent) if self.is_item() else self.mapping(indent)

    def mapping(self, indent: int) -> dict[str, Any]:
        out: dict[str, Any] = {}
        while self.peek() == indent and not self.is_item():
            line = self.lines[self.at]
            m = None if line.lstrip(" ").startswith("\t") else _KEY.fullmatch(line.strip())
            if not m:
                raise HeadError("no key")
            key = quoted(m[1])[0] if m[1][0] in "\"'" else m[1]
            if key in out:
                raise HeadError(f"{key} again")
            out[key] = self.behind(m[2] or "", indent)
        return out

    def behind(self, rest: str, indent: int) -> Any:
        """The value behind a key or a list mark: on the line, in a block, or on the lines below."""
        if re.fullmatch(r"[|>][-+]?", rest.strip()):
            return self.block(rest.strip(), indent)
        if rest.strip() and not rest.lstrip().startswith("#"):
            value = scalar(rest)
            self.at += 1
            return value
        self.at += 1
        below = self.peek()
        if below is not None and (below > indent or (below == indent and self.is_item())):
            return self.value(below)
        return None

    def sequence(self, indent: int) -> list[Any]:
        out = []
        while self.peek() == indent and self.is_item():
            line = self.lines[self.at]
            rest = line.strip()[1:].lstrip()
            if _KEY.fullmatch(rest) or re.match(r"-(\s|$)", rest):
                inner = len(line) - len(rest) if line.endswith(rest) else indent + 2
                self.lines[self.at] = " " * inner + rest  # the item's own lines go on at its first key
                out.append(self.value(inner))
            else:
                out.append(self.behind(rest, indent + 1))
        return out

    def block(self, mark: str, indent: int) -> str:
        self.at += 1
        taken: list[str] = []
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or len(self.lines[self.at]) - len(self.lines[self.at].lstrip(" ")) > indent):
            taken.append(self.lines[self.at])
            self.at += 1
        while taken and not taken[-1].strip():
            taken.pop()
        margin = min((len(x) - len(x.lstrip(" ")) for x in taken if x.strip()), default=0)
        lines = [x[margin:].rstrip() for x in taken]
        text = "\n".join(lines) if mark[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(lines))
        return text if mark.endswith("-") or not text else text + "\n"


def split_page(text: str) -> tuple[str | None, str]:
    """(head, body) of a page's text; without a head block the head is None."""
    m = re.match(r"---[ \t]*\n(.*?)(?:(?<=\n)|\A)---[ \t]*(?:\n|\Z)", text, re.S)
    return (m[1].rstrip("\n"), text[m.end() :]) if m else (None, text)


def read_head(text: str) -> dict[str, Any]:
    return HeadReader(text).read()
