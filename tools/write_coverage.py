"""Regenerate COVERAGE.md from the registry."""

from __future__ import annotations

import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from frayline.plans import load_queries  # noqa: E402

# covered by library functions and tests rather than a registered query
LIBRARY = {
    "S2": "sources.files.write_event_stream (tests/test_files_and_streams.py)",
    "C24": "corpus.agents / players / skills views, rollups.with_names",
    "V7": "timelines._bucket (tests/test_rollups.py)",
    "T7": "rollups.ordered",
}


def main() -> None:
    by_id: dict[str, list[str]] = {}
    for q in load_queries().values():
        for code in q.covers.split():
            by_id.setdefault(code, []).append(f"`{q.name}`" + ("" if q.sql else " (no SQL twin)"))
    key = lambda c: ("SCAWNJFPRTUDGMOVXabc".find(c[0]), int("".join(filter(str.isdigit, c)) or 0), c)
    lines = ["# COVERAGE", "", "Survey id -> registered queries (`frayline/plans`) and library functions.", "", "| Id | Shown by |", "| --- | --- |"]
    for code in sorted(set(by_id) | set(LIBRARY), key=key):
        if code[0].isupper():
            shown = by_id.get(code, []) + ([LIBRARY[code]] if code in LIBRARY else [])
            lines.append(f"| {code} | {', '.join(shown)} |")
    (ROOT / "COVERAGE.md").write_text("\n".join(lines) + "\n")


if __name__ == "__main__":
    main()
