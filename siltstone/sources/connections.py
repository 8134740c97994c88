"""HTTP connections that a worker process keeps and shares between its threads and tasks."""

from __future__ import annotations

import http.client
import queue
import sys
import threading
import types
import urllib.parse
from dataclasses import dataclass, field


@dataclass
class Connections:
    """Kept-alive connections to one server, ``most`` at a time; a call beyond that waits."""

    url: str
    timeout: float
    most: int
    idle: queue.LifoQueue = field(default_factory=queue.LifoQueue)

    def __post_init__(self) -> None:
        self.at = urllib.parse.urlsplit(self.url)
        if self.at.scheme not in ("http", "https") or not self.at.hostname:
            raise ValueError(f"not a web address: {self.url}")
        self.room = threading.BoundedSemaphore(self.most)

    def _new(self) -> http.client.HTTPConnection:
        kind = http.client.HTTPSConnection if self.at.scheme == "https" else http.client.HTTPConnection
        return kind(self.at.hostname, self.at.port, timeout=self.timeout)

    def _call(self, one: http.client.HTTPConnection, body: bytes, headers: dict[str, str]) -> tuple[int, str]:
        path = (self.at.path or "/") + (f"?{self.at.query}" if self.at.query else "")
        try:
            one.request("POST", path, body, headers)
            answer = one.getresponse()
            text = answer.read().decode("utf-8", "replace")
        except BaseException:
            one.close()
            raise
        if answer.will_close:
            one.close()
        self.idle.put(one)  # a closed one opens itself again
        return answer.status, text

    def post(self, body: bytes, headers: dict[str, str]) -> tuple[int, str]:
        """Status and text of the answer. A kept connection that the server has closed meanwhile is no failure: a fresh one takes its place."""
        with self.room:
            try:
                kept = self.idle.get_nowait()
            except queue.Empty:
                return self._call(self._new(), body, headers)
            try:
                return self._call(kept, body, headers)
            except (http.client.RemoteDisconnected, http.client.CannotSendRequest, BrokenPipeError, ConnectionResetError):
                return self._call(self._new(), body, headers)


def connections(url: str, timeout: float, most: int) -> Connections:
    """The pool of this process; tasks that follow each other in a worker have the same one, though each brings this module's code anew."""
    held = sys.modules.setdefault("_siltstone_connections", types.ModuleType("_siltstone_connections")).__dict__
    return held.setdefault((url, timeout, most), Connections(url, timeout, most))
