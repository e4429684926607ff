"""Ignore files: patterns, and the last match that decides."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BASELINE_DIRS = (".ctxcost", ".git", ".nyc_output", "build", "coverage", "dist", "node_modules")


@dataclass(frozen=True)
class Rule:
    regex: str
    negate: bool = False
    dir_only: bool = False
    base: str = ""


def glob_regex(pattern: str) -> str:
    """``*`` and ``?`` stay within a segment. ``**`` crosses them and takes a slash after it along; between two slashes it may stand for nothing, slash included."""
    out = ""
    for part in re.split(r"(\*{2,}/?|\*|\?)", pattern):
        if part.startswith("**"):
            if part.endswith("/") and out.endswith("/"):
                out = out[:-1] + "(?:/.*)?"
            else:
                out += ".*"
        elif part == "*":
            out += "[^/]*"
        elif part == "?":
            out += "[^/]"
        else:
            out += re.sub(r"[.+^${}()|\[\]\\]", r"\\\g<0>", part)
    return out


def parse(text: str, base: str = "") -> list[Rule]:
    """Rules of the ignore file in the directory ``base``, in order."""
    rules = []
    for line in re.split(r"\r?\n", text):
        if not line.strip() or line.startswith("#"):
            continue
        negate = line.startswith("!")
        body = line[negate:].rstrip()
        dir_only = body.endswith("/")
        body = body[:-1] if dir_only else body
        anchored = "/" in body
        body = body.removeprefix("/")
        if body:
            rules.append(Rule(("^" if anchored else "(?:^|.*/)") + glob_regex(body) + "$", negate, dir_only, base))
    return rules


def baseline() -> list[Rule]:
    """Directories that are ignored unless an ignore file says otherwise."""
    return [Rule(f"(?:^|.*/){re.escape(d)}$", dir_only=True) for d in BASELINE_DIRS]


def matches(rule: Rule, path: str) -> bool:
    if rule.base and not path.startswith(rule.base + "/"):
        return False
    own = path[len(rule.base) + 1 :] if rule.base else path
    return own != "" and re.search(rule.regex, own) is not None


def ignores(rules: list[Rule], path: str, is_dir: bool) -> bool:
    for rule in reversed(rules):
        if (is_dir or not rule.dir_only) and matches(rule, path):
            return not rule.negate
    return False


def is_ignored(path: Column, rules: list[Rule], is_dir: bool = False) -> Column:
    """The same on a column of paths; rules are a list that the driver has read."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in reversed(rules):
        if rule.dir_only and not is_dir:
            continue
        own = path.substr(F.lit(len(rule.base) + 2), F.length(path)) if rule.base else path
        fits = own.rlike(rule.regex) & (own != "")
        out = out.when(path.startswith(rule.base + "/") & fits if rule.base else fits, F.lit(not rule.negate))
    return out.otherwise(F.lit(False))
