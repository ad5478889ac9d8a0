"""Exports that are replaced state by state, and that readers see whole or not at all.

A folder holds tables, each with versions (``<table>/version=<id>/state=XX/...``) of the states that one export
wrote, and marks (``_marks/<number>.json``) that name, per table, the version of every state. An export writes its
states into a new version of each table and then, in one rename, a mark in which these states point to it; the others
stay as they were. Readers follow the last mark. An export that breaks leaves no mark, and so changes nothing.
A mark has one entry per table and state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import SparkSession

MARKS = "_marks"


class ConcurrentExport(RuntimeError):
    """Another export has been published meanwhile."""


def _system(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def _names(spark: SparkSession, path: str) -> list[str]:
    system, location = _system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(location)] if system.exists(location) else []


def _last(spark: SparkSession, folder: str) -> int:
    numbers = [int(n[:-5]) for n in _names(spark, f"{folder}/{MARKS}") if n.endswith(".json") and n[:-5].isdigit()]
    return max(numbers, default=0)


def _mark(spark: SparkSession, folder: str, number: int) -> dict[str, dict[str, str]]:
    if not number:
        return {}
    system, location = _system(spark, f"{folder}/{MARKS}/{number:09d}.json")
    source = system.open(location)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def versions(spark: SparkSession, folder: str, table: str) -> dict[str, str]:
    """The version in which each published state of a table is."""
    return _mark(spark, folder, _last(spark, folder)).get(table, {})


def publish(
    spark: SparkSession, folder: str, writes: dict[str, Callable[[str], None]], states: Iterable[str] = (), key: str = "state"
) -> dict[str, dict[str, str]]:
    """Run ``write(path)`` of each table, which writes ``<key>=XX`` folders, and put these states in the place of the published ones.

    ``states`` that are named but not written have no rows any more and go. Returns the published versions.
    """
    before = _last(spark, folder)
    old, version, gone = _mark(spark, folder, before), uuid.uuid4().hex, set(states)
    published = dict(old)
    for table, write in writes.items():
        path = f"{folder}/{table}/version={version}"
        write(path)
        written = [n.removeprefix(f"{key}=") for n in _names(spark, path) if n.startswith(f"{key}=")]
        kept = {s: v for s, v in old.get(table, {}).items() if s not in gone}
        published[table] = {**kept, **dict.fromkeys(written, version)}
    _commit(spark, folder, before + 1, published)
    return published


def _commit(spark: SparkSession, folder: str, number: int, published: dict) -> None:
    system, target = _system(spark, f"{folder}/{MARKS}/{number:09d}.json")
    _, draft = _system(spark, f"{folder}/{MARKS}/.{uuid.uuid4().hex}")
    out = system.create(draft, True)
    try:
        out.write(bytearray(json.dumps(published, sort_keys=True).encode()))
    finally:
        out.close()
    if system.exists(target) or not system.rename(draft, target):
        system.delete(draft, False)
        raise ConcurrentExport(f"{folder} has a mark {number} already")


def paths(spark: SparkSession, folder: str, table: str, states: Sequence[str] | None = None, key: str = "state") -> list[str]:
    """The folders of the published states of a table; read them with ``basePath`` set to the table's folder."""
    current = versions(spark, folder, table)
    return [f"{folder}/{table}/version={v}/{key}={s}" for s, v in sorted(current.items()) if states is None or s in states]


def clean(spark: SparkSession, folder: str) -> int:
    """Delete versions that the last mark does not name; no export may be running. Returns how many went."""
    gone = 0
    for table, published in _mark(spark, folder, _last(spark, folder)).items():
        used = {f"version={v}" for v in published.values()}
        for name in _names(spark, f"{folder}/{table}"):
            if name.startswith("version=") and name not in used:
                system, location = _system(spark, f"{folder}/{table}/{name}")
                system.delete(location, True)
                gone += 1
    return gone
