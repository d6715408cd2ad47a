"""Pieces of a vector passed round between the tasks of a barrier stage.

Tasks tell each other their places once, over the barrier; after that every task
sends to the next one and receives from the one before, so each piece goes round
once and nothing passes through the driver.  A peer that goes away ends the
task, and Spark starts the whole stage again.
"""

from __future__ import annotations

import secrets
import socket

import numpy as np
from pyspark import BarrierTaskContext

#: Seconds without a word from a neighbour after which a task fails.
PATIENCE = 600


class Ring:
    """The tasks of a barrier stage; bounds[k] to bounds[k + 1] is task k's piece of a vector."""

    def __init__(self, context: BarrierTaskContext, bounds: list[int]):
        self.rank, self.size, self.bounds = context.partitionId(), len(bounds) - 1, bounds
        self.left = self.right = None
        if self.size == 1:
            return
        with socket.create_server(("", 0)) as door:
            door.settimeout(PATIENCE)
            host = context.getTaskInfos()[self.rank].address.rsplit(":", 1)[0]
            told = [x.split() for x in context.allGather(f"{host} {door.getsockname()[1]} {secrets.token_hex(16)}")]
            host, port, word = told[(self.rank + 1) % self.size]
            self.right = socket.create_connection((host, int(port)), PATIENCE)
            self.right.sendall(word.encode())
            mine = told[self.rank][2].encode()
            while self.left is None:
                found, _ = door.accept()
                found.settimeout(PATIENCE)
                said = bytearray(len(mine))
                if self._fill(found, memoryview(said)) and secrets.compare_digest(bytes(said), mine):
                    self.left = found
                else:  # not one of this stage's tasks
                    found.close()
        for end in (self.left, self.right):
            end.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _fill(end: socket.socket, into: memoryview) -> bool:
        """Whether all of into was received."""
        while len(into):
            got = end.recv_into(into)
            if not got:
                return False
            into = into[got:]
        return True

    def gather(self, y: np.ndarray) -> None:
        """y has this task's piece; fills in those of the others."""
        view, width = memoryview(y).cast("B"), y.itemsize
        piece = lambda k: view[self.bounds[k] * width : self.bounds[k + 1] * width]
        for step in range(self.size - 1):
            sent, due = piece((self.rank - step) % self.size), piece((self.rank - step - 1) % self.size)
            # Neighbours take turns, so no two wait for each other to read.
            for sends in (self.rank % 2 == 0, self.rank % 2 == 1):
                if sends:
                    self.right.sendall(sent)
                elif not self._fill(self.left, due):
                    raise ConnectionError("a neighbour is gone")

    def __enter__(self) -> Ring:
        return self

    def __exit__(self, *_) -> None:
        for end in (self.left, self.right):
            if end is not None:
                end.close()
