"""Text that is safe where braces and angle brackets are code: indented code is fenced, unsafe parts of prose become code."""

from __future__ import annotations

import re

from loomdoc.functions.code import COLORS, language_of

# HTML tags that stay, and schemes of addresses in angle brackets.
SAFE_TAGS = {"span", "strong", "em", "a", "br", "code", "aside", "badge"}
SCHEMES = ("http://", "https://", "ftp://")

BULLET = re.compile(r"\s*(?:[-*]|\d+\.)")
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.:@/-")

#: What stands instead of a piece of the line, and where it ends; None if the character means nothing there.
Read = tuple[str, int] | None


def in_code(text: str) -> str:
    return f"`{text}`"


def read_code(line: str, at: int) -> Read:
    """A code span is kept."""
    end = line.find("`", at + 1)
    return (line[at : end + 1], end + 1) if end > 0 else None


def read_escape(line: str, at: int) -> Read:
    return (line[at : at + 2], at + 2) if line[at + 1 : at + 2] in ("{", "}") else None


def read_color(line: str, at: int) -> Read:
    """A colour marker is kept."""
    color, bar, _ = line[at + 2 : at + 9].partition("|")
    end = line.find("@@", at + 2)
    known = line.startswith("@@", at) and bar and color in COLORS and end > 0
    return (line[at : end + 2], end + 2) if known else None


def read_back_link(line: str, at: int) -> Read:
    """A link back (its label begins with an arrow) goes."""
    middle = line.find("](", at)
    end = line.find(")", middle)
    return ("", end + 1) if line.startswith("[<-", at) and line.find("]", at) == middle > 0 and end > 0 else None


def read_brace(line: str, at: int) -> Read:
    """Braces without others between them are code, empty ones literal; so is one alone that no code mark touches."""
    close, inner = line.find("}", at + 1), line.find("{", at + 1)
    if line[at] == "{" and close > 0 and not at < inner < close:
        content = line[at + 1 : close]
        return (in_code(line[at : close + 1]) if content.strip() else r"\{\}"), close + 1
    touched = line[max(0, at - 1) : at] in ("`", "\\") and at > 0 or line[at + 1 : at + 2] == "`"
    return (line[at] if touched else in_code(line[at])), at + 1


def read_angle(line: str, at: int) -> Read:
    """Components and safe tags are kept, addresses become links, arrows arrows, any other tag code."""
    if line.startswith("<->", at):
        return "↔", at + 3
    if line.startswith("<-", at):
        return None if line.startswith("<->", at) else ("←", at + 2)
    end = line.find(">", at)
    if end < 0:
        return None
    found = line[at + 1 : end]
    name = found.removeprefix("/")
    if not name:
        return in_code(line[at : end + 1]), end + 1
    if "A" <= name[0] <= "Z" and name.split()[0].rstrip("/").isalnum():
        return line[at : end + 1], end + 1
    if not (name[0].isascii() and name[0].isalpha()):
        return None
    if NAME_CHARS.issuperset(name):
        return _tag(found), end + 1
    has_attributes = found[0] != "/" and found.split()[0].replace("_", "a").isalnum() and len(found.split()) > 1
    return (in_code(line[at : end + 1]), end + 1) if has_attributes else None


def _tag(found: str) -> str:
    name = found.lower().removeprefix("/")
    if name.startswith(SCHEMES):
        return f"[{found}]({found})"
    if name.startswith("mailto:"):
        return f"[{found.partition(':')[2]}]({found})"
    return f"<{found}>" if name.partition(":")[0] in SAFE_TAGS else in_code(f"<{found}>")


READERS = {"`": read_code, "\\": read_escape, "@": read_color, "[": read_back_link, "{": read_brace, "}": read_brace, "<": read_angle}
#: Characters that no reader looks at.
PLAIN_RUN = re.compile(rf"[^{re.escape(''.join(READERS))}]+")


def safe_prose(line: str) -> str:
    """A line of prose, read once from left to right; each reader looks at one opening character."""
    out, at = [], 0
    while at < len(line):
        if plain := PLAIN_RUN.match(line, at):
            piece, at = plain[0], plain.end()
        else:
            piece, at = READERS[line[at]](line, at) or (line[at], at + 1)
        out.append(piece)
    return "".join(out)


def safe_markdown(text: str) -> str:
    """A page's Markdown: runs of lines indented by four (no bullets) become fences, prose outside fences is made safe;
    headings are literal."""
    out, run, blank, fenced = [], [], [], False

    def close_run() -> None:
        if run:
            out.extend([f"```{language_of(run)}", *run, "```"])
            run.clear()
        out.extend(blank)
        blank.clear()

    for line in text.split("\n"):
        indented = line.startswith("    ") and line.strip()
        if not fenced and run and not line.strip():
            blank.append(line)
            continue
        if not fenced and indented and (run or not BULLET.match(line)) and not line.lstrip().startswith("```"):
            run.extend([x[4:] for x in blank] + [line[4:]])
            blank.clear()
            continue
        close_run()
        if line.lstrip().startswith("```"):
            fenced = not fenced
            out.append(line)
        else:
            out.append(line if fenced or re.match(r"#{1,6}\s", line) else safe_prose(line))
    close_run()
    return "\n".join(out)
