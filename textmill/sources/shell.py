"""Commands on the driver, opt-in: (seq, channel, text) chunks with one counter over both channels.

Never inside a task: a task may be retried, a command must run at most once.
"""

from __future__ import annotations

import codecs
import os
import queue
import subprocess
import threading
import time
from dataclasses import dataclass, field

from ..errors import CorpusError, invalid

TIMEOUT_MS, MOST_MS = 120_000, 24 * 3600 * 1000
CAP = 16 << 20
IDLE_S = 0.1


@dataclass
class Ran:
    stdout: str = ""
    stderr: str = ""
    exit_code: int | None = None
    signal: int | None = None
    timed_out: bool = False
    duration_us: int = 0
    output_truncated: bool = False
    chunks: list[tuple[int, str, str]] = field(default_factory=list)


def run(command: str, cwd: str | None = None, timeout_ms: int = TIMEOUT_MS, env: list[tuple[str, str]] = (), env_clear: bool = False, shell: tuple[str, ...] = ("/bin/sh", "-c"), allow: bool = False) -> Ran:
    """Run one command. After it ends, output is read until both pipes were idle for 100 ms. UTF-8 sequences are never
    split; beyond 16 MiB output is drained and dropped."""
    if not allow:
        raise CorpusError("permission", "commands run only with allow=True, on the driver")
    if not 0 < timeout_ms <= MOST_MS:
        raise invalid("timeout out of range")
    began, out, got = time.monotonic(), Ran(), queue.Queue()
    full = ({} if env_clear else dict(os.environ)) | dict(env)
    p = subprocess.Popen([*shell, command], cwd=cwd, env=full, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True)

    def pump(name: str, pipe) -> None:
        while data := os.read(pipe.fileno(), 65536):
            got.put((name, data))
        got.put((name, None))

    for name, pipe in (("stdout", p.stdout), ("stderr", p.stderr)):
        threading.Thread(target=pump, args=(name, pipe), daemon=True).start()
    decoders = {n: codecs.getincrementaldecoder("utf-8")("replace") for n in ("stdout", "stderr")}
    texts: dict[str, list[str]] = {"stdout": [], "stderr": []}
    ended, size, idle = 0, 0, None

    def take(name: str, text: str) -> None:
        nonlocal size
        room = CAP - size
        if len(text) > room:
            out.output_truncated = True
        if text[:room]:
            size += len(text[:room])
            texts[name].append(text[:room])
            out.chunks.append((len(out.chunks), name, text[:room]))

    while ended < 2:
        try:
            name, data = got.get(timeout=0.02)
            idle = None
            if data is None:
                ended += 1
                take(name, decoders[name].decode(b"", True))
            else:
                take(name, decoders[name].decode(data))
            continue
        except queue.Empty:
            pass
        if p.poll() is not None:
            idle = idle or time.monotonic()
            if time.monotonic() - idle >= IDLE_S:
                break
        elif (time.monotonic() - began) * 1000 > timeout_ms:
            out.timed_out = True
            os.killpg(p.pid, 9)
    code = p.wait()
    out.exit_code, out.signal = (code, None) if code >= 0 else (None, -code)
    out.stdout, out.stderr = ("".join(texts[n]) for n in ("stdout", "stderr"))
    out.duration_us = int((time.monotonic() - began) * 1e6)
    return out
