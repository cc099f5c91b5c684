"""The driver's task scheduler (T1-T9): admission by dependencies, mutexes and scope caps over a thread pool. Not data-parallel, so not a query."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Task:
    id: str
    run: Callable[[], object]
    depends_on: tuple[str, ...] = ()
    mutex: tuple[str, ...] = ()
    scopes: tuple[str, ...] = ()


@dataclass
class Settlement:
    """state: completed, failed, blocked or cancelled-before-start."""

    state: str
    value: object = None
    error: BaseException | None = None
    blockers: tuple[str, ...] = ()


@dataclass
class Scheduler:
    limit: int = 4
    scope_limits: dict[str, int] = field(default_factory=dict)

    def check(self, tasks: list[Task]) -> None:
        ids = [t.id for t in tasks]
        if len(set(ids)) < len(ids):
            raise ValueError("task ids repeat")
        if unknown := sorted({d for t in tasks for d in t.depends_on} - set(ids)):
            raise ValueError(f"unknown dependencies: {', '.join(unknown)}")
        by, colour = {t.id: t for t in tasks}, dict.fromkeys(ids, 0)
        for root in ids:
            stack = [(root, iter(by[root].depends_on))] if not colour[root] else []
            if stack:
                colour[root] = 1
            while stack:
                at, rest = stack[-1]
                step = next(rest, None)
                if step is None:
                    colour[at] = 2
                    stack.pop()
                elif colour[step] == 1:
                    raise ValueError(f"dependency cycle through {step}")
                elif not colour[step]:
                    colour[step] = 1
                    stack.append((step, iter(by[step].depends_on)))

    def run(self, tasks: list[Task], cancel: threading.Event | None = None) -> dict[str, Settlement]:
        """Settle every task. Failed tasks block those that need them, directly or not; cancelling lets running ones end."""
        self.check(tasks)
        done: dict[str, Settlement] = {}
        running: dict[Future, Task] = {}
        waiting = list(tasks)
        with ThreadPoolExecutor(max(1, self.limit)) as pool:
            while waiting or running:
                self._block(waiting, done)
                if cancel is not None and cancel.is_set():
                    done |= {t.id: Settlement("cancelled-before-start") for t in waiting}
                    waiting = []
                else:
                    for t in self._admitted(waiting, running.values(), done):
                        waiting.remove(t)
                        running[pool.submit(t.run)] = t
                if not running:
                    continue
                for f in wait(running, timeout=0.1 if cancel is not None else None, return_when=FIRST_COMPLETED).done:
                    t = running.pop(f)
                    done[t.id] = Settlement("failed", error=f.exception()) if f.exception() else Settlement("completed", f.result())
        return {t.id: done[t.id] for t in tasks}

    def _block(self, waiting: list[Task], done: dict[str, Settlement]) -> None:
        again = True
        while again:
            again = False
            for t in [t for t in waiting if all(d in done for d in t.depends_on)]:
                bad = [d for d in t.depends_on if done[d].state != "completed"]
                if bad:
                    roots = {b for d in bad for b in (done[d].blockers if done[d].state == "blocked" else (d,))}
                    done[t.id] = Settlement("blocked", blockers=tuple(sorted(roots)))
                    waiting.remove(t)
                    again = True

    def _admitted(self, waiting: list[Task], running: Iterable[Task], done: dict[str, Settlement]) -> list[Task]:
        """In declared order, but tasks of the tightest scope first, so that a scarce scope isn't left idle."""
        busy, taken, out = list(running), set(), []
        for t in busy:
            taken.update(t.mutex)
        cap = lambda t: min((self.scope_limits.get(s, self.limit) for s in t.scopes), default=self.limit)
        for t in sorted((t for t in waiting if all(d in done for d in t.depends_on)), key=cap):
            inside = all(sum(s in b.scopes for b in busy) < self.scope_limits.get(s, self.limit) for s in t.scopes)
            if len(busy) < self.limit and inside and not taken & set(t.mutex):
                busy.append(t)
                taken.update(t.mutex)
                out.append(t)
        return out


def pooled(work: Callable, items: list, limit: int = 4) -> list:
    """Results in the order of the items."""
    with ThreadPoolExecutor(limit) as pool:
        return list(pool.map(work, items))
