"""Time-step loops with carried state, checkpoint and restart."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from ..operators.loop import Dat, Mesh, Opt, Reduce
from ..operators.reduction import Reduction
from ..plans.catalog import READ, Field, MeshError
from ..sources.shared import remove
from ..sources.store import read_text


class Checkpointer:
    """Saves chosen fields, a payload and the history of reduction results at most every
    ``interval`` seconds, or when told to; restores the latest complete save.

    A save is a folder of its own; its ``done`` file comes last, so a save that was cut short is
    never restored. The last ``keep`` saves stay, with what they refer to; older ones are removed.
    """

    def __init__(self, mesh: Mesh, path: str, fields: list[Field], interval: float = 4.0, keep: int = 2):
        if interval <= 0 or keep < 1:
            raise MeshError("the checkpoint interval has to be positive, and one save at least has to stay")
        self.mesh, self.path, self.fields, self.interval, self.keep = mesh, path.rstrip("/"), fields, interval, keep
        self.saved: dict[int, set[int]] = {}  # the saves that each save refers to
        self.history: list[list[Any]] = []
        self.where: dict[str, int] = {}  # the save that has each field
        self.last = time.monotonic()

    def result(self, handle: Reduction) -> Any:
        """Reads a reduction out and keeps the value for a restart."""
        value = handle.result()
        self.history.append([handle.name, value])
        return value

    def due(self) -> bool:
        return time.monotonic() - self.last >= self.interval

    def save(self, step: int, payload: dict | None = None, changed: set[tuple[str, str]] | None = None) -> None:
        """``changed`` fields (all if it is not given) are written; the others stay where the save before
        has them."""
        spark, at = self.mesh.spark, f"{self.path}/{step:08d}"
        for f in self.fields:
            name = f"{f.block.name}/{f.name}"
            if changed is None or (f.block.name, f.name) in changed or name not in self.where:
                self.mesh.table(f).write.mode("overwrite").parquet(f"{at}/{name}")
                self.where[name] = step
        done = json.dumps({"step": step, "payload": payload or {}, "history": self.history, "where": self.where})
        spark.createDataFrame([(done,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/done")
        self.last = time.monotonic()
        self._kept(step)

    def _kept(self, step: int) -> None:
        self.saved[step] = {step, *self.where.values()}
        newest = sorted(self.saved)[-self.keep :]
        needed = set().union(*(self.saved[k] for k in newest))
        for old in [k for k in self.saved if k not in newest]:
            if old in needed:  # its fields are, itself it is not to be restored any more
                remove(self.mesh.spark, f"{self.path}/{old:08d}/done")
            else:
                remove(self.mesh.spark, f"{self.path}/{old:08d}")
                del self.saved[old]

    def latest(self) -> dict | None:
        saves = [json.loads(r) for r in read_text(self.mesh.spark, f"{self.path}/*/done")]  # one row for each save
        self.saved |= {x["step"]: {x["step"], *x["where"].values()} for x in saves}
        return max(saves, key=lambda x: x["step"], default=None)

    def restore(self) -> dict | None:
        """Sets the fields to the latest save and returns what it was saved with, or None."""
        found = self.latest()
        if found is None:
            return None
        for f in self.fields:
            name = f"{f.block.name}/{f.name}"
            self.mesh.set_values(f, self.mesh.spark.read.parquet(f"{self.path}/{found['where'][name]:08d}/{name}"))
        self.history, self.where = found["history"], found["where"]
        return found


class Replay:
    """Restarts a program that is run again from its begin: loops that the latest save has behind it are
    skipped, and reductions that were read out then give the values of then.

    Loops before ``ready`` (declarations and starting values) always run. A save is made between loops
    when it is due and no reduction is waiting to be read out; it has the fields written since the last.
    """

    def __init__(self, checkpointer: Checkpointer):
        self.saver, self.found = checkpointer, checkpointer.latest()
        self.begun, self.count, self.told = False, 0, 0
        self.changed: set[tuple[str, str]] = set()
        self.open: set[str] = set()
        self.stats = {"skipped": 0, "run": 0, "saves": 0}
        if not self.found:
            self.found = {"step": 0, "history": []}

    def ready(self) -> None:
        """The end of the initial phase."""
        self.begun = True

    def loop(self, name: str, block: Any, box: Any, kernel: Callable[..., None], **args: Any) -> None:
        plain = [a.arg if isinstance(a, Opt) and a.flag else a for a in args.values()]
        if self.begun:
            self.count += 1
            if self.count <= self.found["step"]:
                self.stats["skipped"] += 1
                if self.count == self.found["step"]:
                    self.saver.restore()
                    self.changed = set()
                return
            if not self.open and self.count - 1 > self.found["step"] and self.saver.due():
                self.saver.save(self.count - 1, changed=self.changed)
                self.changed = set()
                self.stats["saves"] += 1
        self.saver.mesh.loop(name, block, box, kernel, **args)
        self.stats["run"] += 1
        self.open |= {a.handle.name for a in plain if isinstance(a, Reduce)}
        self.changed |= {(a.field.block.name, a.field.name) for a in plain if isinstance(a, Dat) and a.access != READ}

    def result(self, handle: Reduction) -> Any:
        """Reads a reduction out, or what it was when the loops up to here were run."""
        if self.begun and self.told < len(self.found["history"]):
            name, value = self.found["history"][self.told]
            if name != handle.name:
                raise MeshError(f"the save has the result of {name} here, not of {handle.name}")
            self.told += 1
            return value
        self.open.discard(handle.name)
        if not self.begun:
            return handle.result()
        self.told += 1
        return self.saver.result(handle)


def run_steps(step: Callable[[int], Any], steps: int, checkpointer: Checkpointer | None = None, payload: Callable[[], dict] | None = None) -> int:
    """Runs ``step(k)`` up to ``steps``, from the latest save if there is one; returns the first k."""
    start = 0
    if checkpointer and (found := checkpointer.restore()):
        start = found["step"]
    for k in range(start, steps):
        step(k)
        if checkpointer and checkpointer.due():
            checkpointer.save(k + 1, payload() if payload else None)
    return start


def until(step: Callable[[int], float], tolerance: float, most: int) -> tuple[int, float]:
    """Steps until what a step returns is at most ``tolerance``."""
    error, k = float("inf"), 0
    while error > tolerance and k < most:
        error = step(k)
        k += 1
    return k, error


def timings(mesh: Mesh) -> DataFrame:
    """Of each loop its calls, seconds of planning, seconds of running and bandwidth (null unless the mesh
    has ``profile``), and the bytes that it has to read and write at least."""
    rows = [(r.name, r.calls, r.planned, r.seconds or None, r.bytes, r.bytes / r.seconds / 1e9 if r.seconds else None, ",".join(r.fields)) for r in mesh.records.values()]
    return mesh.spark.createDataFrame(rows, "loop string, calls int, planned double, seconds double, bytes long, gb_per_second double, fields string")
