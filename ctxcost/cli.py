"""Command line: ``python -m ctxcost [--json | --emit-ignore] [--budget N] [PATH]``."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from . import runtime
from .plans import report
from .plans.scan import scan


def _number(text: str) -> float:
    n = float(text)
    if n != n:
        raise ValueError
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("ctxcost", description="What the files of a source tree cost a coding session, and which are safe to trim.", epilog="Exit code 1: an explicit budget is exceeded. 2: an error.")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--json", action="store_true", help="all findings and totals as JSON of a stable schema")
    p.add_argument("--emit-ignore", action="store_true", help="patches of the ignore files; nothing is written")
    p.add_argument("--budget", type=_number, help="resident tokens that fail the run when exceeded; comes before the settings file")
    p.add_argument("--reuse", help="a folder outside of PATH that keeps measures of unchanged files")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        result = scan(runtime.session(), args.path, args.budget, reuse=args.reuse)
        if args.json and args.emit_ignore:
            print("--json and --emit-ignore exclude each other", file=sys.stderr)
            return 2
        if args.json:
            print(report.render_json(result))
        elif args.emit_ignore:
            patches = []
            for name in report.IGNORE_FILES:
                at = os.path.join(result.root, name)
                existing = None
                if os.path.exists(at):
                    with open(at, encoding="utf-8", newline="") as f:
                        existing = f.read()
                patches.append(report.render_ignore_patch(existing, result.findings, name))
            print("\n".join(p for p in patches if p), end="")
        else:
            print(report.render_table(result))
        return int(result.budget_explicit and result.rollup.over_budget)
    except Exception as e:
        print(f"ctxcost: the scan failed: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 2
