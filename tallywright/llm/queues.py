"""A priority queue of arrays that goes to disk: a task pushes and pops whole blocks of tuples, never one at a time.

Tuples are records of one dtype with a field `key`; equal keys come out in the order in which they went in. What exceeds
`limit` bytes is sorted and written as a run to the given folder (Arrow's URI of a scratch folder that a cluster shares), and goes when it has been read. Popping merges the
runs block by block, so memory is bounded by `limit` and a block of each run, however many tuples have one key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

#: Tuples of a block.
BLOCK = 1 << 14


class Run:
    """A sorted run of records in a file, read once from its start."""

    def __init__(self, records: np.ndarray, folder: str):
        self.dtype, self.left = records.dtype, len(records)
        self.store, inside = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        self.store.create_dir(inside, recursive=True)
        self.path, self.source = f"{inside}/{uuid.uuid4().hex}", None
        with self.store.open_output_stream(self.path) as out:
            out.write(records.tobytes())

    def read(self, count: int) -> np.ndarray:
        if self.source is None:
            self.source = self.store.open_input_stream(self.path)
        count = min(count, self.left)
        out = np.frombuffer(self.source.read(count * self.dtype.itemsize), self.dtype)
        self.left -= count
        if not self.left:
            self.source.close()
            self.store.delete_file(self.path)
        return out


class Held(Run):
    """A run that is still in memory."""

    def __init__(self, records: np.ndarray):
        self.records, self.left = records, len(records)

    def read(self, count: int) -> np.ndarray:
        out = self.records[:count]
        self.records = self.records[count:]
        self.left = len(self.records)
        return out


def ordered(parts: list[np.ndarray]) -> np.ndarray:
    all_ = np.concatenate(parts) if len(parts) != 1 else parts[0]
    return all_[np.argsort(all_["key"], kind="stable")]


class DiskQueue:
    def __init__(self, limit: int, folder: str):
        self.limit, self.folder = limit, folder
        self.parts: list[np.ndarray] = []
        self.bytes = self.count = 0
        self.runs: list[Run] = []

    def push(self, records: np.ndarray) -> None:
        if len(records):
            self.parts.append(records)
            self.bytes += records.nbytes
            self.count += len(records)
        if self.bytes > self.limit:
            self.runs.append(Run(ordered(self.parts), self.folder))
            self.parts, self.bytes = [], 0

    def pop(self) -> Iterator[np.ndarray]:
        """All records in order, in blocks; the queue is empty afterwards."""
        runs, self.runs = self.runs, []
        if self.parts:
            runs.append(Held(ordered(self.parts)))
        self.parts, self.bytes, self.count = [], 0, 0
        if len(runs) == 1:
            while runs[0].left:
                yield runs[0].read(BLOCK)
            return
        heads = [run.read(BLOCK) for run in runs]
        while any(len(h) for h in heads):
            # what is below the last key of every block that another follows is complete
            ends = [h["key"][-1] for h, run in zip(heads, runs) if run.left]
            cut = min(ends) if ends else None
            at = [len(h) if cut is None else int(np.searchsorted(h["key"], cut)) for h in heads]
            if any(at):
                yield ordered([h[:n] for h, n in zip(heads, at)])
                heads = [h[n:] for h, n in zip(heads, at)]
            else:  # blocks that begin with the cut's key: all of it, run after run
                for i, run in enumerate(runs):
                    while len(heads[i]) and heads[i]["key"][0] == cut:
                        n = int(np.searchsorted(heads[i]["key"], cut, "right"))
                        yield heads[i][:n]
                        heads[i] = heads[i][n:]
                        if not len(heads[i]) and run.left:
                            heads[i] = run.read(BLOCK)
            heads = [run.read(BLOCK) if not len(h) and run.left else h for h, run in zip(heads, runs)]
