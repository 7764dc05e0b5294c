"""Colours of spans and languages of code blocks."""

from __future__ import annotations

import re

# Colours that are kept.
COLORS = ("red", "green", "blue", "orange", "yellow")
# Languages by the interpreter of a first line, in the order of trial; words by what they tell of a line.
INTERPRETERS = [("bash", "bash"), ("/sh", "bash"), ("python", "python"), ("perl", "perl"), ("php", "php")]
SQL_PAIRS = {
    "insert into", "delete from", "create table", "create database", "create index", "drop table", "drop database", "alter table"
}
SQL_VERBS = {"select", "grant"}
C_TYPES = {"typedef", "struct", "enum"}
SCRIPT_WORDS = {
    "loadmodule", "modparam", "request_route", "onreply_route", "failure_route", "branch_route", "local_route", "startup_route", "timer_route"
}
SETTINGS = {"listen", "children", "fork", "debug", "log_stderror", "disable_core_dump", "auto_aliases", "mpath"}
PERL_PAIRS = {"use strict", "use warnings"}
TOOLS = {
    "grep", "awk", "sed", "curl", "wget", "chmod", "chown", "systemctl", "apt-get", "yum", "make", "cmake", "ngrep", "tshark", "tcpdump"
}
SHELL_WORDS = {"if", "for", "while", "case", "function"}
#: Of all languages that lines tell of, the first of these is the block's.
ORDER = ("php", "sql", "c", "perl", "bash")


def is_sql(words: list[str]) -> bool:
    low = [w.lower() for w in words[:3]]
    return len(low) > 1 and (low[0] in SQL_VERBS or " ".join(low[:2]) in SQL_PAIRS or (low[0] == "update" and low[2:] == ["set"]))


def is_c(line: str, words: list[str], tokens: list[str]) -> bool:
    """C, or a routing script, which is shown as C."""
    if line.startswith("#include") or SCRIPT_WORDS & set(tokens) or any(t in C_TYPES for t in tokens[:-1]):
        return True
    name, equals, _ = line.partition("=")
    if equals and name.rstrip() in SETTINGS:
        return True
    return any(t == "route" for t in tokens) and line.partition("route")[2].lstrip()[:1] in ("[", "{")


def is_perl(words: list[str]) -> bool:
    pairs = list(zip(words, words[1:], strict=False))
    if any(f"{a} {b.rstrip(';')}" in PERL_PAIRS or (a == "my" and b.startswith("$")) for a, b in pairs):
        return True
    return any(a == "sub" and (b.endswith("{") or words[i + 2 : i + 3] == ["{"]) for i, (a, b) in enumerate(pairs))


def is_shell(line: str, words: list[str], tokens: list[str]) -> bool:
    return line.startswith(("$ ", "# ", "$\t", "#\t")) or bool(TOOLS & set(tokens)) or (len(words) > 1 and not line[0].isspace() and words[0] in SHELL_WORDS)


def languages_of(line: str) -> set[str]:
    """The languages that a line tells of."""
    words = line.split()
    if not words:
        return set()
    tokens = re.findall(r"\w+(?:-\w+)*", line)
    found = {"php"} if "<?php" in line else set()
    found |= {"sql"} if is_sql(words) else set()
    found |= {"c"} if is_c(line, words, tokens) else set()
    found |= {"perl"} if is_perl(words) else set()
    return found | ({"bash"} if is_shell(line, words, tokens) else set())


def language_of(lines: list[str]) -> str:
    """The fence language of a code block: that of its interpreter line, else what its lines tell of."""
    first = next((x.strip() for x in lines if x.strip()), "")
    if first.startswith("#!"):
        for sign, language in INTERPRETERS:
            if sign in first:
                return language
    found = set().union(*map(languages_of, lines)) if lines else set()
    return next((language for language in ORDER if language in found), "text")
