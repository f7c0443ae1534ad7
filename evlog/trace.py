"""Instrumentation: spans and refusals through ``logging``. Payloads (meta, data, parameters) are never emitted."""

from __future__ import annotations

import contextlib
import logging
import time
from collections.abc import Iterator
from typing import Any

LOGGER = logging.getLogger("evlog")
CLIP = 256


def clip(sql: str) -> str:
    return sql if len(sql) <= CLIP else sql[:CLIP] + "…"


@contextlib.contextmanager
def span(name: str, **fields: Any) -> Iterator[dict[str, Any]]:
    """A span ``evlog.<name>``; what the body adds to the fields is logged with the time it took."""
    began = time.perf_counter()
    try:
        yield fields
    except Exception as e:
        LOGGER.warning("evlog.%s refused: %s %s", name, type(e).__name__, fields, extra={"span": f"evlog.{name}", "fields": dict(fields), "error": type(e).__name__})
        raise
    fields["ms"] = round((time.perf_counter() - began) * 1000, 3)
    LOGGER.debug("evlog.%s %s", name, fields, extra={"span": f"evlog.{name}", "fields": dict(fields)})
