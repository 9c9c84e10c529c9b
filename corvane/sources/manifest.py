"""Versions of a stored collection: numbered manifests that name the folders it consists of.

A version holds from the moment its manifest is there, so what a writer leaves behind that fails before is never read; of two
writers that follow the same version the second one fails, for a manifest is never overwritten.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

from . import storage

PREFIX, SUFFIX = "manifest-", ".json"


class Conflict(RuntimeError):
    """Another writer has made the next version."""


def _numbers(spark: SparkSession, path: str) -> list[int]:
    names = storage.names(spark, path)
    return sorted(int(n[len(PREFIX) : -len(SUFFIX)]) for n in names if n.startswith(PREFIX) and n.endswith(SUFFIX) and n[len(PREFIX) : -len(SUFFIX)].isdigit())


def _at(path: str, version: int) -> str:
    return f"{path}/{PREFIX}{version:08d}{SUFFIX}"


def load(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[str, Any]]:
    """The latest version, or a given one, and its content; version 0 and nothing if there is none. A manifest that is being written isn't there yet."""
    for n in reversed(_numbers(spark, path)):
        if version is not None and n != version:
            continue
        try:
            return n, json.loads(storage.read_text(spark, _at(path, n)))
        except json.JSONDecodeError:
            continue
    if version is not None:
        raise FileNotFoundError(f"no version {version} at {path}")
    return 0, {}


def commit(spark: SparkSession, path: str, content: dict[str, Any], after: int) -> int:
    """Writes the version that follows `after`."""
    try:
        storage.write_text(spark, _at(path, after + 1), json.dumps(content, indent=1))
    except FileExistsError:
        raise Conflict(f"version {after + 1} of {path} exists already") from None
    return after + 1


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes manifests but the last `keep`, and the folders that none of these names; what was deleted."""
    numbers = _numbers(spark, path)
    held = {f for n in numbers[-keep:] for f in load(spark, path, n)[1].get("folders", [])}
    old = [f"{PREFIX}{n:08d}{SUFFIX}" for n in numbers[:-keep]]
    gone = [*old, *(n for n in storage.names(spark, path) if n.startswith("part-of-") and n not in held)]
    for name in gone:
        storage.delete(spark, f"{path}/{name}")
    return gone
