"""Ignore rules in the syntax of .gitignore files, matched against one relative path at a time."""

from __future__ import annotations

import re


def _translate(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.*", i + 3
        elif c == "*":
            while i < len(pattern) and pattern[i] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


class IgnoreRules:
    """The last rule that matches a path, or a folder above it, decides; ! takes a path out again."""

    def __init__(self, text: str) -> None:
        self.rules: list[tuple[re.Pattern, bool]] = []
        for raw in text.splitlines():
            line = raw.rstrip("\r")
            stripped = line.rstrip(" ")
            line = stripped + " " if stripped.endswith("\\") and stripped != line else stripped
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            folder = line.endswith("/")
            line = line.rstrip("/")
            if not line:
                continue
            anchored = "/" in line
            body = _translate(line.lstrip("/"))
            start = "^" if anchored else "^(?:.*/)?"
            self.rules.append((re.compile(start + body + ("/.*$" if folder else "(?:/.*)?$"), re.S), not keep))

    def ignored(self, path: str) -> bool:
        found = False
        for rule, ignore in self.rules:
            if rule.match(path):
                found = ignore
        return found
