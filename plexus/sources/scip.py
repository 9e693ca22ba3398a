"""Occurrences of symbols from index files in protocol-buffer form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Field numbers of the format.
DOCUMENT, PATH, OCCURRENCE, RANGE, SYMBOL, ROLES = 2, 1, 2, 1, 2, 3
MAX_SYMBOL_BYTES, MAX_INT = 4096, 2**31 - 1


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = 0
    for shift in range(0, 70, 7):
        if at >= len(data):
            raise ValueError("the index is truncated")
        byte = data[at]
        value, at = value | (byte & 127) << shift, at + 1
        if byte < 128:
            return value, at
    raise ValueError("an integer is too long")


def _fields(data: memoryview) -> Iterator[tuple[int, int, int | memoryview]]:
    """(field, wire type, value) of a message: integers as such, everything else as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        field, wire = tag >> 3, tag & 7
        if not field or wire not in (0, 1, 2, 5):
            raise ValueError("a field is invalid")
        if wire == 0:
            value, at = _varint(data, at)
            yield field, wire, value
            continue
        size = {1: 8, 5: 4}.get(wire)
        if size is None:
            size, at = _varint(data, at)
        if at + size > len(data):
            raise ValueError("the index is truncated")
        yield field, wire, data[at : at + size]
        at += size


def _occurrence(data: memoryview) -> tuple[int, str, bool] | None:
    places, symbol, roles = [], "", 0
    for field, wire, value in _fields(data):
        if field == RANGE and wire == 0:
            places.append(value)
        elif field == RANGE and wire == 2:
            at = 0
            while at < len(value):
                place, at = _varint(value, at)
                places.append(place)
        elif field == SYMBOL and wire == 2:
            if len(value) > MAX_SYMBOL_BYTES:
                raise ValueError("a symbol is too long")
            symbol = str(value, "utf-8")
        elif field == ROLES and wire == 0:
            roles = value
        elif field in (RANGE, SYMBOL, ROLES):
            raise ValueError("an occurrence is invalid")
    if len(places) not in (3, 4) or max(places) > MAX_INT:
        raise ValueError("a range is invalid")
    return None if not symbol or symbol.startswith("local ") else (places[0] + 1, symbol, bool(roles & 1))


def decode(data: bytes) -> Iterator[tuple[str, int, str, bool]]:
    """(path, line counted from one, symbol, whether it is defined there); local and empty symbols are left out."""
    for field, wire, value in _fields(memoryview(data)):
        if field != DOCUMENT:
            continue
        if wire != 2:
            raise ValueError("a document is invalid")
        path, found = None, []
        for part, kind, inner in _fields(value):
            if part in (PATH, OCCURRENCE) and kind != 2:
                raise ValueError("a document is invalid")
            if part == PATH:
                path = str(inner, "utf-8")
            elif part == OCCURRENCE:
                found.append(_occurrence(inner))
        if path is None or path.startswith("/") or "\\" in path or any(p in ("", ".", "..") for p in path.split("/")):
            raise ValueError("a path is missing or unsafe")
        yield from ((path, *o) for o in found if o)


def occurrences(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, line, symbol, definition) of each occurrence of each row's ``content`` (null: none); a bad index fails.

    Files are decoded where they lie; rows leave in pieces of bounded size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "line", "symbol", "definition"]
        for batch in batches:
            for data in batch["content"]:
                held = []
                for row in decode(data or b""):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=columns)
                        held = []
                yield pd.DataFrame(held, columns=columns)

    return files.selectExpr(f"`{content}` AS content").mapInPandas(run, "path string, line long, symbol string, definition boolean")
