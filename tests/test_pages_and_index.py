"""Index files byte by byte, names of symbols, pages and their tokens."""

import pytest
from pyspark.sql import functions as F

from plexus.functions import scalars as S
from plexus.plans import pages
from plexus.sources import scip


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def part(field, value):
    return varint(field << 3) + varint(value) if isinstance(value, int) else varint(field << 3 | 2) + varint(len(value)) + value


def occurrence(line, symbol, roles=0, places=3):
    return part(1, b"".join(map(varint, [line, 2, 300, 4][:places]))) + part(2, symbol.encode()) + (part(3, roles) if roles else b"")


def document(path, *found):
    return part(2, part(1, path.encode()) + b"".join(part(2, o) for o in found))


def test_occurrences(spark):
    data = part(1, b"meta") + document("src/a.rs", occurrence(9, "m/f().", 1), occurrence(200, "m/f().", 8, 4), occurrence(1, "local 3"), occurrence(1, "")) + document("b.rs")
    found = scip.occurrences(spark.createDataFrame([(bytearray(data),), (None,), (bytearray(),)], "content binary")).collect()
    assert sorted(map(tuple, found)) == [("src/a.rs", 10, "m/f().", True), ("src/a.rs", 201, "m/f().", False)]


@pytest.mark.parametrize("data", [document("/a"), document("a/../b"), part(2, b""), document("a", occurrence(1, "x#", places=2)), document("a", occurrence(1, "x" * 4097)), document("a")[:-1], document("a", occurrence(2**31, "x#")), b"\x80"])
def test_bad_index(data):
    with pytest.raises(ValueError):
        list(scip.decode(data))


def test_symbol_name(spark):
    cases = {
        "c x 1 m/Name#": "Name", "c x 1 name.": "name", "c x 1 T#name().": "name", "c x 1 T#name(+1).": "name", "c x 1 name!": "name", "c x 1 `a b`#": "a b",
        "c x 1 ``a`#": None, "c x 1 `a``b`#": None, "local 1": None, "c x 1 ).": None, "c x 1 f()#": None, "c x 1 a/": None, "c x 1 é_+-$1.": "é_+-$1", "": None,
    }
    rows = spark.createDataFrame([*cases.items(), (None, None)], "symbol string, want string").select("symbol", "want", S.symbol_name(F.col("symbol")).alias("got")).collect()
    assert [(r.symbol, r.got) for r in rows] == [(r.symbol, r.want) for r in rows]


def test_pages(spark):
    text = ["one", "two", "é€x"]
    lines = spark.createDataFrame([("r", i, t) for i, t in enumerate(text)] + [("other", 0, "zz")], "r string, i int, line string")
    whole = "".join(t + "\n" for t in text).encode()

    def one(start, budget, most=99):
        got = pages.page(lines, spark.createDataFrame([("r", start, budget)], "r string, start long, budget long"), "r", "i", "line", most).collect()
        return [(r.end, r.text, r.records, r.partial, r.total) for r in got]

    assert one(0, 5) == [(4, "one\n", 1, False, 15)] and one(0, 3) == [(3, "one", 0, True, 15)] and one(4, 100) == [(15, "two\né€x\n", 2, False, 15)]
    assert one(2, 6) == [(8, "e\ntwo\n", 2, False, 15)] and one(0, 100, 2) == [(8, "one\ntwo\n", 2, False, 15)]
    assert one(8, 3) == [(10, "é", 0, True, 15)] and one(8, 5) == [(13, "é€", 0, True, 15)] and one(8, 1) == [(8, "", 0, True, 15)] and one(15, 9) == []
    for budget in (4, 5, 7):
        at, parts = 0, []
        while at < len(whole):
            ((end, part, *_),) = one(at, budget)
            parts.append(part)
            at = end
        assert "".join(parts).encode() == whole


def test_shares(spark):
    rows = spark.createDataFrame([("a", i, u) for i, u in enumerate([True, False, True, True])] + [("b", 0, False)], "r string, i int, unfinished boolean")
    got = pages.shares(rows, 11, "r", "i").orderBy("r", "i").collect()
    assert [r.budget for r in got] == [4, 0, 4, 3, 0]


def test_tokens():
    cursor = pages.Cursor((0, 10, 2, 3, 4), 6, 50, "a" * 64)
    token = cursor.token("r")
    assert len(token) <= pages.MAX_TOKEN and pages.read_token(token, "r", 6, 50, "a" * 64) == cursor
    for bad, args in (
        (token, ("r", 6, 50, "b" * 64)), (token, ("r", 5, 50, "a" * 64)), (token, ("other", 6, 50, "a" * 64)), (token.replace(":10:", ":010:"), ("r", 6, 50, "a" * 64)),
        (token.replace(":10:", ":11:"), ("r", 6, 50, "a" * 64)), (token + ":", ("r", 6, 50, "a" * 64)), ("", ("r", 6, 50, "a" * 64)), ("v3:" + "9" * 300, ("r", 6, 50, "a" * 64)),
    ):
        with pytest.raises(ValueError):
            pages.read_token(bad, *args)
