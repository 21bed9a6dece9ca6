"""Parsers of diffs and stack traces, signatures and ignore rules: small texts, plain Python on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class FileDiff:
    path: str
    hunks: list[tuple[int, int]] = field(default_factory=list)  # first line and count in the old file
    removed: list[str] = field(default_factory=list)
    added: list[str] = field(default_factory=list)


def parse_diff(text: str) -> list[FileDiff]:
    """Files of a unified diff; hunk headers say how many lines belong to a hunk."""
    out: list[FileDiff] = []
    old = new = 0
    source = ""
    for line in text.replace("\r\n", "\n").split("\n"):
        if old > 0 or new > 0:
            mark, rest = line[:1], line[1:]
            if mark != "\\":
                old -= mark != "+"
                new -= mark != "-"
                if mark == "-":
                    out[-1].removed.append(rest)
                elif mark == "+":
                    out[-1].added.append(rest)
            continue
        if line.startswith("--- "):
            source = line[4:].split("\t")[0]
        elif line.startswith("+++ "):
            name = line[4:].split("\t")[0]
            name = source if name == "/dev/null" else name
            out.append(FileDiff(re.sub(r"^[ab]/", "", name)))
        elif (m := re.match(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,(\d+))? @@", line)) and out:
            old, new = int(m[2] or 1), int(m[3] or 1)
            out[-1].hunks.append((int(m[1]), old))
    return out


# Extensions of source files in traces.
TRACE_SUFFIXES = frozenset("swift py js jsx ts tsx mjs cjs go rs java kt rb php m mm c cc cpp h hpp".split())


def _place(text: str) -> tuple[str, int] | None:
    """path and line of ``path:line`` or ``path:line:column``."""
    parts = text.split(":")
    numbers = 0
    while numbers < 2 and len(parts) - numbers > 1 and parts[-1 - numbers].isdigit():
        numbers += 1
    path = ":".join(parts[: len(parts) - numbers])
    return (path, int(parts[len(parts) - numbers])) if numbers and path else None


def _frames_of(line: str, runtime: bool) -> list[tuple[str, int, str | None]]:
    """Frames of one line; the first form that fits decides."""
    text = line.strip()
    at = text.find('File "')
    if at >= 0:  # Python
        path, _, rest = text[at + 6 :].partition('"')
        words = rest.replace(",", " ").split()
        if len(words) >= 2 and words[0] == "line" and words[1].isdigit():
            return [(path, int(words[1]), words[3] if len(words) > 3 and words[2] == "in" else None)]
    words = text.replace(",", " ").split()
    low = [w.lower() for w in words]
    if runtime and "file" in low:  # a runtime's report
        k = low.index("file")
        if low[k + 2 : k + 3] == ["line"] and "." in words[k + 1] and low[k + 3 : k + 4] and low[k + 3].isdigit():
            return [(words[k + 1], int(low[k + 3]), None)]
    if words and "at" in words[:-1]:  # JavaScript: at name (place), at place
        k = words.index("at") + 1
        k += words[k] == "async" and k + 1 < len(words)
        inside = text[text.rfind("(") + 1 : text.rfind(")")] if "(" in text and ")" in text else ""
        place, name = (_place(inside), words[k]) if inside else (_place(words[k]), None)
        if place:
            return [(*place, name)]
    if len(words) == 2 and words[1].startswith("+0x"):  # Go
        place = _place(words[0])
        if place and place[0].endswith(".go"):
            return [(*place, None)]
    out = []
    for w in text.replace("(", " ").replace(")", " ").replace(",", " ").split():
        place = _place(w.rstrip(".;"))
        if place and place[0].rsplit(".", 1)[-1] in TRACE_SUFFIXES:
            out.append((*place, None))
    return out


def parse_trace(text: str, runtime: bool = True) -> list[tuple[str, int, str | None]]:
    """(path, line, symbol) of each frame in text order; without ``runtime`` a runtime's report has none of its own."""
    return [f for line in text.splitlines() for f in _frames_of(line, runtime) if f[1] > 0]


def glob_regex(pattern: str, crosses: bool) -> str:
    star, one = (".*", ".") if crosses else ("[^/]*", "[^/]")
    return "".join(star if c == "*" else one if c == "?" else re.escape(c) for c in pattern)


def ignored(pattern: str, path: str) -> bool:
    """Whether an ignore pattern covers a path: ``dir/`` any directory of it, with a slash the whole path, else the name."""
    if pattern.endswith("/"):
        body = pattern[:-1]
        parts = path.strip("/").split("/")
        dirs = ["/".join(parts[:i]) for i in range(1, len(parts) + path.endswith("/"))]
        if "/" in body:
            return any(re.fullmatch(glob_regex(body, False), d) for d in dirs)
        return any(re.fullmatch(glob_regex(body, True), d.rsplit("/", 1)[-1]) for d in dirs)
    return re.fullmatch(glob_regex(pattern, True), path if "/" in pattern else path.rsplit("/", 1)[-1]) is not None


def arity(declaration: str) -> int | None:
    """Number of parameters in the first bracketed list after a name; commas inside nested brackets don't count."""
    opened = next((i for i in range(1, len(declaration)) if declaration[i] == "(" and (declaration[:i].rstrip()[-1:].isalnum() or declaration[:i].rstrip()[-1:] == "_")), None)
    if opened is None:
        return None
    depth, commas, empty = 0, 0, True
    for c in declaration[opened + 1 :]:
        if c in ")]}" and depth == 0:
            break
        depth += (c in "([{<") - (c in ")]}>")
        commas += c == "," and depth == 0
        empty = empty and c.isspace()
    return 0 if empty else commas + 1
