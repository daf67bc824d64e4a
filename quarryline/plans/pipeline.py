"""Tasks with dependencies, run once each, with hooks around them and progress for whoever watches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Task:
    """A named step: ``run`` gets the results of the steps it needs by name."""

    name: str
    run: Callable[..., Any]
    needs: tuple[str, ...] = ()


class Progress:
    """A hook that keeps what happened: (task, state, seconds)."""

    def __init__(self):
        self.events: list[tuple[str, str, float]] = []

    @contextmanager
    def around(self, task: Task):
        began = time.monotonic()
        self.events.append((task.name, "in_progress", 0.0))
        try:
            yield
        except Exception:
            self.events.append((task.name, "failed", round(time.monotonic() - began, 3)))
            raise
        self.events.append((task.name, "completed", round(time.monotonic() - began, 3)))

    def state(self, name: str) -> str:
        return next((s for n, s, _ in reversed(self.events) if n == name), "queued")


@dataclass
class Executor:
    """Runs tasks after what they need, each once; ``again`` runs one anew with what is there."""

    tasks: dict[str, Task]
    hooks: list = field(default_factory=list)
    results: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, *tasks: Task, hooks: list | None = None) -> Executor:
        return cls({t.name: t for t in tasks}, hooks or [])

    def order(self, *names: str) -> list[str]:
        """The tasks that the named ones need, in an order that can be run; a cycle is an error."""
        out: list[str] = []
        state: dict[str, int] = {}
        for wanted in names or tuple(self.tasks):
            stack = [(wanted, False)]
            while stack:
                name, done = stack.pop()
                if done:
                    state[name] = 2
                    out.append(name)
                elif state.get(name) is None:
                    if name not in self.tasks:
                        raise KeyError(f"no task {name!r}")
                    state[name] = 1
                    stack.append((name, True))
                    for need in reversed(self.tasks[name].needs):
                        if state.get(need) == 1:
                            raise ValueError(f"{name!r} and {need!r} need each other")
                        stack.append((need, False))
        return out

    def _run(self, task: Task) -> Any:
        with ExitStack() as stack:
            for hook in self.hooks:
                stack.enter_context(hook.around(task))
            self.results[task.name] = task.run(**{n: self.results[n] for n in task.needs})
        return self.results[task.name]

    def run(self, *names: str) -> dict[str, Any]:
        for name in self.order(*names):
            if name not in self.results:
                self._run(self.tasks[name])
        return self.results

    def again(self, name: str) -> Any:
        self.run(*self.tasks[name].needs) if self.tasks[name].needs else None
        return self._run(self.tasks[name])

    def stream(self, *names: str) -> Iterator[tuple[str, str]]:
        """(task, state) as tasks begin and end."""
        for name in self.order(*names):
            if name in self.results:
                continue
            yield name, "in_progress"
            try:
                self._run(self.tasks[name])
            except Exception:
                yield name, "failed"
                raise
            yield name, "completed"


def first_that_answers(*models: Callable[[str], str], attempts: int = 1) -> Callable[[str], str]:
    """A model that asks the first of ``models``, and the next ones where it fails or says nothing."""

    def ask(prompt: str) -> str:
        last: Exception | None = None
        for model in models:
            for _ in range(attempts):
                try:
                    reply = model(prompt)
                except Exception as e:  # noqa: BLE001 - whatever a provider raises
                    last = e
                    continue
                if reply and reply.strip():
                    return reply
        raise RuntimeError("no model answered") from last

    return ask


def indexing_tasks(files: Callable[[], Any], folder: str | None = None) -> Executor:
    """The indexing job as tasks: files, graph, links, chunks and the written index."""
    from quarryline.plans.index_job import GraphBuild

    tasks = [
        Task("files", files),
        Task("graph", lambda files: GraphBuild(files), ("files",)),
        Task("links", lambda graph: graph.links, ("graph",)),
        Task("chunks", lambda graph: graph.chunks(), ("graph",)),
        Task("index", lambda graph, chunks, links: graph.write(folder) if folder else None, ("graph", "chunks", "links")),
    ]
    return Executor.of(*tasks)


#: The three jobs and the tasks they end with.
JOBS = {"full_index": ("index",), "graph_only": ("graph",), "links_only": ("links",)}
