"""Reading a file page by page under a limit that binds: a page that hangs is ended, and the file goes on without it."""

from __future__ import annotations

import multiprocessing
from collections.abc import Iterator
from multiprocessing.connection import Connection
from typing import Any, Protocol

SECONDS = 10.0


class Reader(Protocol):
    """Opens paged files; a page is (height, width, lines), a line (spans, x0, y0, x1, y1, dy, block), a span (text, size)."""

    def pages(self, content: bytes) -> int: ...

    def page(self, content: bytes, n: int) -> tuple: ...


def _serve(asked: Connection, reader: Reader, content: bytes) -> None:
    while True:
        try:
            n = asked.recv()
        except EOFError:
            return
        try:
            asked.send((reader.page(content, n) if n else reader.pages(content), None))
        except Exception as error:  # noqa: BLE001  whatever a reader raises is told of the page
            asked.send((None, f"{type(error).__name__}: {error}"))


class _Child:
    """A process that reads pages of one file; it is ended if an answer takes longer than ``seconds``, and made anew when asked again."""

    def __init__(self, reader: Reader, content: bytes, seconds: float):
        self.reader, self.content, self.seconds, self.process, self.line = reader, content, seconds, None, None

    def ask(self, n: int) -> tuple[Any, str | None]:
        if self.process is None:
            context = multiprocessing.get_context("fork")
            self.line, theirs = context.Pipe()
            self.process = context.Process(target=_serve, args=(theirs, self.reader, self.content), daemon=True)
            self.process.start()
            theirs.close()
        try:
            self.line.send(n)
            if self.line.poll(self.seconds):
                return self.line.recv()
            problem = "timed out"
        except (EOFError, BrokenPipeError, ConnectionResetError):
            problem = "the reader died"
        self.end()
        return None, problem

    def end(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.line.close()
            self.process = self.line = None


def read(reader: Reader, content: bytes, seconds: float = SECONDS, part: int = 0, parts: int = 1) -> Iterator[tuple[int, Any, str | None]]:
    """(page from 1, what was read, problem) of a file, or of one of equal parts of its pages; a problem with the file itself is page 0's."""
    child = _Child(reader, content, seconds)
    try:
        total, problem = child.ask(0)
        if problem is not None:
            if part == 0:
                yield 0, None, problem
            return
        for n in range(total * part // parts + 1, total * (part + 1) // parts + 1):
            page, problem = child.ask(n)
            yield n, page, problem
    finally:
        child.end()
