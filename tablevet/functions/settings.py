"""Session settings that several threads may need at once."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_lock = threading.Lock()
_held: dict[tuple[int, str], tuple[str, list[str]]] = {}


@contextmanager
def held_setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Hold a setting; of several holders the largest number counts, the last one restores it."""
    session = id(spark), key
    with _lock:
        before, values = _held.setdefault(session, (spark.conf.get(key), []))
        values.append(value)
        spark.conf.set(key, max(values, key=_size))
    try:
        yield
    finally:
        with _lock:
            values.remove(value)
            spark.conf.set(key, max(values, key=_size) if values else before)
            if not values:
                del _held[session]


def _size(value: str) -> int:
    return int(value) if value.isdigit() else 0
