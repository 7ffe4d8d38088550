"""Named steps that run one after the other and say which one failed."""

from __future__ import annotations

import logging
from collections.abc import Callable

from textloom.sources.config import Bootstrap

log = logging.getLogger("textloom")


class StepFailed(RuntimeError):
    """A step raised an error, which is this one's cause."""

    def __init__(self, name: str):
        super().__init__(f"step {name} failed")
        self.name = name


def run_steps(steps: list[tuple[str, Callable[[], object]]], wanted: dict[str, bool] | None = None) -> dict[str, object]:
    """The results of all steps by name; those that wanted turns off are left out."""
    out: dict[str, object] = {}
    for name, step in steps:
        if wanted is not None and not wanted.get(name, True):
            log.info("step %s: off", name)
            continue
        log.info("step %s: begins", name)
        try:
            out[name] = step()
        except Exception as e:
            raise StepFailed(name) from e
    return out


class SomeFailed(RuntimeError):
    """Some of many steps failed; statuses says which and why."""

    def __init__(self, statuses: dict[str, str]):
        bad = {n: s for n, s in statuses.items() if s.startswith("failed: ")}
        super().__init__(f"{len(bad)} of {len(statuses)} failed: " + "; ".join(f"{n}: {s[8:]}" for n, s in bad.items()))
        self.statuses = statuses


def run_all(steps: list[tuple[str, Callable[[], object]]], done: str = "imported") -> dict[str, str]:
    """Run all steps, whichever fail; the status of each, or SomeFailed with all statuses in the end."""
    statuses: dict[str, str] = {}
    for name, step in steps:
        try:
            step()
            statuses[name] = done
        except Exception as e:
            log.exception("step %s failed", name)
            statuses[name] = f"failed: {e}"
    if any(s.startswith("failed: ") for s in statuses.values()):
        raise SomeFailed(statuses)
    return statuses


def bootstrap_steps(config: Bootstrap, download: Callable[[], object], imported: Callable[[], object], export: Callable[[], object]) -> dict[str, object]:
    """The steps of a bootstrap that its configuration turns on, in order."""
    return run_steps([("download", download), ("import", imported), ("export", export)], {"download": config.download_dumps, "import": config.import_dumps, "export": config.export_seeds})


def exit_code(action: Callable[[], object]) -> int:
    """0 if it ends well, 2 if a step failed, 3 for any other error."""
    try:
        action()
    except (StepFailed, SomeFailed) as e:
        log.error("%s: %s", e, e.__cause__)
        return 2
    except Exception:
        log.exception("failed")
        return 3
    return 0
