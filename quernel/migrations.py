"""Migrations: numbered scripts with an up and a down part, recorded in a table of the database.

A plan is made from two sets of numbers, those wanted and those recorded. The highest number in both is the *base*; with
``force`` the last wanted step does not count for it, so that it runs anew. What is recorded above the base is undone, from
the highest on, with the script that was recorded; then what is wanted above the base runs, from the lowest on. Steps up to
the base stay as they ran, whatever their scripts say by now. Each step and its record change together: a script that fails
leaves the state before that step.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from quernel.errors import QueryError


@dataclass(frozen=True)
class Step:
    """One migration."""

    id: int
    name: str
    up: str
    down: str


def sections(text: str) -> dict[str, str]:
    """The parts of a script by the marker line (``-- Up``, ``-- Down``) above them; what has none is for going up."""
    parts: dict[str, list[str]] = {"up": [], "down": []}
    at = "up"
    for line in text.splitlines():
        dashes, *words = line.split() or [""]
        if dashes == "--" and words and words[0].lower() in parts:
            at = words[0].lower()
        else:
            parts[at].append(line)
    return {k: "\n".join(v).strip() for k, v in parts.items()}


def steps(source: Iterable[dict] | str) -> dict[int, Step]:
    """Steps by number: of a folder of files such as ``001-name.sql``, or given as dictionaries."""
    if isinstance(source, str):
        files = [(re.match(r"\d+", p.stem), p) for p in Path(source).glob("*.sql")]
        found = [Step(int(m[0]), p.stem[m.end() :].lstrip("-_. "), **sections(p.read_text())) for m, p in files if m]
    else:
        found = [Step(int(m["id"]), m["name"], m["up"], m.get("down") or "") for m in source]
    if not found:
        raise QueryError("there are no migrations")
    out = {s.id: s for s in found}
    if len(out) < len(found):
        raise QueryError("two migrations have one number")
    return out


def plan(wanted: set[int], recorded: set[int], force: bool) -> tuple[list[int], list[int]]:
    """Numbers to undo and numbers to run, each in order."""
    common = wanted & recorded - ({max(wanted)} if force else set())
    base = max(common, default=min(wanted | recorded) - 1)
    return sorted((i for i in recorded if i > base), reverse=True), sorted(i for i in wanted if i > base)


def migrate(engine, source: Iterable[dict] | str, force: bool = False, table: str = "migrations") -> list[int]:
    """Carries out the plan; the numbers recorded at the end."""
    wanted, name = steps(source), '"' + table.replace('"', '""') + '"'
    engine.none(f"create table if not exists {name} (id integer primary key, name text not null, up text not null, down text not null)")
    recorded = {r["id"]: Step(**r) for r in engine.many(f"select id, name, up, down from {name}")}
    undo, run = plan(set(wanted), set(recorded), force)
    for i in undo:
        engine.together([(recorded[i].down, None), (f"delete from {name} where id = $1", [i])])
    for i in run:
        s = wanted[i]
        engine.together([(s.up, None), (f"insert into {name} values ($1, $2, $3, $4)", [s.id, s.name, s.up, s.down])])
    return sorted(recorded.keys() - set(undo) | set(run))
