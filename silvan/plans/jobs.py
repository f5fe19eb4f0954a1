"""An ordered list of steps with ranges, exceptions and a dry run."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[], object]


def select(steps: Sequence[Step], only: Sequence[str] = (), first: str | None = None, last: str | None = None, skip: Sequence[str] = ()) -> list[Step]:
    """only overrides all else; otherwise first to last, without skip. An unknown name is an error."""
    names = [s.name for s in steps]
    for n in [*only, *skip, *(x for x in (first, last) if x)]:
        if n not in names:
            raise KeyError(n)
    if only:
        return [s for s in steps if s.name in only]
    begin, end = names.index(first) if first else 0, names.index(last) + 1 if last else len(names)
    return [s for s in steps[begin:end] if s.name not in skip]


def run(steps: Sequence[Step], dry: bool = False, keep_going: bool = False) -> dict[str, float | None]:
    """Seconds of each step, None for one not run. keep_going: a failing step does not stop the others, but raises at the end."""
    took: dict[str, float | None] = {}
    failed: list[str] = []
    for s in steps:
        began = time.perf_counter()
        took[s.name] = None
        if dry:
            continue
        try:
            s.run()
            took[s.name] = time.perf_counter() - began
        except Exception:
            if not keep_going:
                raise
            failed.append(s.name)
    if failed:
        raise RuntimeError(f"failed: {', '.join(failed)}")
    return took


def product(profiles: Sequence[str], methods: Sequence[str], make: Callable[[str, str], Callable[[], object]]) -> list[Step]:
    """A step for each method of each profile, profile by profile, as a run over all projections goes."""
    return [Step(f"{profile}/{method}", make(profile, method)) for profile in profiles for method in methods]
