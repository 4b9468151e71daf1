"""Progress of a run as server-sent events: any number of ``progress``, then one ``result`` or one ``error``."""

from __future__ import annotations

import json
import queue
import threading
from collections.abc import Callable, Iterator


def event(kind: str, value) -> str:
    return f"event: {kind}\ndata: {json.dumps(value, separators=(',', ':'))}\n\n"


def server_events(run: Callable, clean: Callable[[str], str] = str) -> Iterator[str]:
    """Events of ``run(progress)``, which may call ``progress(stage, detail, share)`` and returns what JSON can hold; ``clean`` takes secrets out of an error's text."""
    told: queue.Queue = queue.Queue()

    def work() -> None:
        try:
            result = run(lambda stage, detail, share: told.put(("progress", {"stage": stage, "detail": detail, "share": share})))
            told.put(("result", result))
        except Exception as e:  # whatever it is, the listener is told
            told.put(("error", {"message": clean(str(e))}))

    threading.Thread(target=work, daemon=True).start()
    while True:
        kind, value = told.get()
        yield event(kind, value)
        if kind != "progress":
            return
