"""A scan as JSON, as a table, or as a patch of an ignore file."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import score
from .scan import Result

SCHEMA_VERSION = 1
IGNORE_FILES = (".claudeignore", ".cursorignore")
_BAR = 10


def _rounded(x: float) -> int:
    return math.floor(x + 0.5)


def _plain(x: float) -> int | float:
    return int(x) if float(x).is_integer() else x


def json_report(result: Result) -> dict:
    r = result.rollup
    rows = result.findings.orderBy("det_ord", "seq", "emit_ord").select("path", "detector", "confidence", "reason", "suggest")
    totals = {"fileCount": r.file_count, "residentTokens": r.resident_tokens, "reachableTokens": r.reachable_tokens, "ambientTokens": r.ambient_tokens}
    totals |= {"budget": _plain(r.budget), "overBudget": r.over_budget, "overagePct": r.overage_pct, "recoverableTokens": r.recoverable_tokens}
    return {"schemaVersion": SCHEMA_VERSION, "root": result.root, "rollup": totals, "findings": [x.asDict() for x in rows.toLocalIterator()]}


def render_json(result: Result) -> str:
    return json.dumps(json_report(result), indent=2, ensure_ascii=False)


def format_tokens(n: float) -> str:
    n = _rounded(n)
    if n >= 1_000_000:
        return f"{n / 1_000_000:.1f}M"
    return f"{_rounded(n / 1000)}k" if n >= 100_000 else f"{n:,}"


def format_cell(n: float) -> str:
    """``format_tokens`` as the table prints it: half a tenth of a million goes up, in whole numbers, where the other takes a tie to the even digit."""
    n = _rounded(n)
    if n < 1_000_000:
        return format_tokens(n)
    tenths = (n + 50_000) // 100_000
    return f"{tenths // 10}.{tenths % 10}M"


def bar(resident: float, budget: float) -> str:
    full = max(0, min(_BAR, _rounded(resident / budget * _BAR))) if budget > 0 else 0
    return "█" * full + "░" * (_BAR - full)


def render_table(result: Result) -> str:
    """Totals, then the twenty worst files by what to do about them, or the resident files if nothing was found."""
    r = result.rollup
    out = [
        f"{'Resident context':<18}{format_cell(r.resident_tokens) + ' tok':<12}{bar(r.resident_tokens, r.budget)}  (budget {format_cell(r.budget)} tok)  {'+' if r.overage_pct >= 0 else ''}{r.overage_pct}%",
        f"{'Repo reachable':<18}{format_cell(r.reachable_tokens)} tok",
    ]
    if r.ambient_tokens > 0:
        out.append(f"{'Ambient noise':<18}{format_cell(r.ambient_tokens)} tok")
    found = not result.findings.isEmpty()
    if found:
        n = result.ranked.count()
        out.append(f"{'Top trim':<18}{format_cell(r.recoverable_tokens)} tok recoverable across {n} file{'s' * (n != 1)}")
    out.append("")
    if not found:
        out.append("No findings — showing resident files by token cost.")
        resident = score.resident_top(result.files).orderBy(F.desc("tokens"), "seq").collect()
        if resident:
            out += ["", f"  {'RESIDENT':<50}tokens"]
            out += [f"  {x.path:<50}{format_cell(x.tokens)}{' ~' * x.estimated}" for x in resident]
        else:
            out.append("(no T0 resident files found — no CLAUDE.md / AGENTS.md / .cursorrules in this tree)")
        return "\n".join(out)
    worst = score.top(result.files, result.findings, result.ctx.cadence).orderBy(F.desc("waste"), "seq").collect()
    for suggest in ("ignore", "split", "delete", "review"):
        own = [x for x in worst if x.suggest == suggest]
        if own:
            out += [f"  {suggest.upper()}", f"  {'PATH':<50}{'DETECTOR':<16}{'CONF':<6}REASON"]
            out += [f"  {x.path:<50}{x.detector:<16}{f'{x.confidence:.2f}':<6}{x.reason}" for x in own]
    return "\n".join(out)


def render_ignore_patch(existing: str | None, findings: DataFrame, name: str = IGNORE_FILES[0]) -> str:
    """A unified diff that adds what is safe to ignore to the end of an ignore file; empty if there is nothing to add."""
    lines = [] if existing is None else re.split(r"\r?\n", existing)
    stated = [(x.strip(),) for x in lines if x.strip() and not x.strip().startswith("#")]
    known = findings.sparkSession.createDataFrame(stated, "line string")
    new = [x.path for x in score.ignore_additions(findings, known).toLocalIterator()]
    if not new:
        return ""
    if lines and lines[-1] == "":
        lines = lines[:-1]
    before, source = (0, "/dev/null") if existing is None else (len(lines), f"a/{name}")
    start = 0 if existing is None else 1
    body = [f" {x}" for x in lines] + [f"+{x}" for x in new]
    return "\n".join([f"--- {source}", f"+++ b/{name}", f"@@ -{start},{before} +1,{before + len(new)} @@", *body]) + "\n"
