"""The operators against brute force, round trips and held-out labels, and on rows that are odd."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plexus.llm import common, components, embeddings, mixing, packing, quality, queries, sharding, simhash, token_counts, toxicity, warc, winnowing

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, score double, size long, _text string"
ODD = ["", None, " ", "one", "two words", "word " * 9000, "x" * 70_000, "Ünï ÇödÉ 漢字 'll don't", "same text here again and again", "same text here again and again", "<|endoftext|> a"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", ["a", None, "b"][i % 3], 0, "e", 0.1, 7, "clash") for i, t in enumerate(ODD)] + [(None, "no id", "en", "a", 0, "e", 0.1, 7, "c"), (3, "one", "en", "a", 0, "e", 0.1, 7, "c")]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(8)] + [(None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def smallest(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), con.execute(queries.SQL[name])
    key = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert df.columns == [d[0] for d in want.description] and key(df.collect()) == key(want.fetchall())


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 420)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = smallest(500, pairs)
    assert got == {x: want[x] for p in pairs if p[0] != p[1] for x in p}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1


def test_fill():
    shards, slots = [f"s{i}" for i in range(7)], 211
    table = sharding.fill(shards, slots)
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    order = [[(number(f"offset|{s}") + j * (number(f"skip|{s}") % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards]
    want, turn = {}, 0
    while len(want) < slots:
        want[next(p for p in order[turn % 7] if p not in want)] = turn % 7
        turn += 1
    assert table == [want[i] for i in range(slots)]
    fewer = sharding.fill(shards[:-1], slots)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < slots // 4
    with pytest.raises(ValueError):
        sharding.fill(shards, 210)


def test_place_odd(spark, odd, none):
    got = sharding.place(odd.withColumn("slot", F.lit("x")), ["a", "b"], slots=13)
    assert got.count() == odd.count() and got.where("slot is null or shard is null").count() == 0
    assert got.where("doc_id = 3").select("shard").distinct().count() == 1 and sharding.place(none, ["a"], slots=13).count() == 0
    assert sharding.place(odd, ["a", "b"], slots=13, spread=["text"]).count() == odd.count()


# -- 2


@pytest.mark.parametrize("tile", [8192, 64])
def test_vectors(spark, tile):
    r = np.random.default_rng(0)
    heart = r.standard_normal((20, 64))
    v = np.vstack([heart[r.integers(20, size=250)] + r.standard_normal((250, 64)) * r.choice([0.05, 0.2, 0.35, 0.5], 250)[:, None], r.standard_normal((100, 64)), np.repeat(heart[:1], 60, 0)]).astype(np.float32)
    rows = [(i, x.tolist(), "c") for i, x in enumerate(v)] + [(2000, None, "c"), (2001, [0.0] * 64, "c"), (2002, [float("nan")] * 64, "c"), (2003, [], "c"), (2004, [None] * 64, "c"), (2005, [float("inf")] * 64, "c"), (0, v[0].tolist(), "c")]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string"), tile=tile).toPandas()
    v = np.vstack([v, v[:1]])
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    link = np.einsum("ij,kj->ik", unit, unit) >= 0.9
    np.fill_diagonal(link, False)
    ids = [*range(len(v) - 1), 0]
    want = [(i, int(n), ids[c], i == ids[c]) for i, n, c in zip(ids, link.sum(1), smallest(len(v), np.argwhere(link)), strict=True)] + [(i, 0, i, True) for i in range(2000, 2006)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(want)
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# -- 3


def plain_print(text, width):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    got = queries.op3_simhash_near_dedup(spark, SF).toPandas().sort_values("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    prints = np.array([plain_print(t, 3) for t in docs["text"]], np.uint64)
    assert got["fingerprint"].tolist() == [f"{x:016x}" for x in prints]
    links = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
    assert got["component_id"].tolist() == [docs["doc_id"].iloc[c] for c in smallest(len(prints), links)]


def test_tree_finds_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for k in rng.integers(1, 6, 3000)], np.uint64)
    points = np.unique(np.concatenate([base[rng.integers(60, size=3000)] ^ flips, rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    links = simhash.near_links(spark.createDataFrame(pd.DataFrame({"fingerprint": points.view(np.int64)})), shard_rows=100).toPandas()
    at = {x: i for i, x in enumerate(points.view(np.int64).tolist())}
    pairs = [(at[a], at[b]) for a, b in zip(links["a"], links["b"], strict=True)]
    assert smallest(len(points), pairs) == smallest(len(points), np.argwhere(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3))


def test_simhash_odd(spark, odd, none):
    got = simhash.near_duplicates(odd, 3).collect()
    assert len(got) == odd.count() and {r.fingerprint for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert {r.component_id for r in got if r.doc_id in (8, 9)} == {8} and simhash.near_duplicates(none, 3).count() == 0


def words_sets(texts, width=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def plain_near(texts):
    """Groups of texts by brute-force Jaccard of at least 0.8; texts without words are one group."""
    sets = words_sets(texts)
    same = lambda a, b: len(a & b) * 10 >= 8 * len(a | b)
    return smallest(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if same(sets[i], sets[j])])


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts, line = [None, "", " ", "a b", "A b", "a b c"], " ".join(word() for _ in range(30))
    for n in (8, 40, 150, 400):
        for _ in range(6):
            base = [word() for _ in range(n)]
            texts += [" ".join(word() if rng.random() < p else w for w in base) for p in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.06)]
            texts.append(line + " " + " ".join(base[: n // 2]))
    base = [word() for _ in range(60)]  # a large group, where most pairs are less alike than 0.8
    texts += [" ".join(word() if rng.random() < 0.02 else w for w in base) for _ in range(150)]
    real = pd.read_parquet(f"{SF}/documents.parquet")["text"].tolist()
    for some in (texts, real):
        got = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t) for i, t in enumerate(some)], "doc_id long, text string"), SF)
        assert sorted(r.doc_id for r in got.collect()) == sorted(set(plain_near(some)))


def test_near_dedup_at_the_border(spark):
    """Pairs of a Jaccard of just 0.8 and just below: each of the first is found, none of the others."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    rows, stay = [], set()
    for k in range(400):
        base, other = [word() for _ in range(94)], 10 + k % 2  # 90 shingles: 80 of 100 are shared, or 79 of 101
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:-other] + [word() for _ in range(other)]))]
        stay |= {2 * k, 2 * k + 1} if k % 2 else {2 * k}
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert {r.doc_id for r in got} == stay and len(got) == len(stay)


def test_prefixes_and_prints_rule_nothing_out():
    """Sets of Jaccard 0.8 or more share a hash of their prefixes, whatever is common, and differ in no more bits than may be."""
    from plexus.llm import near_copies

    rng, seen = np.random.default_rng(6), 0
    for _ in range(3000):
        pool = rng.permutation(rng.integers(0, 1 << 64, 900, dtype=np.uint64))
        n, cut = int(rng.integers(1, 400)), int(rng.integers(0, 60))
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[min(cut, n - 1) : n], pool[500 : 500 + int(rng.integers(0, 60))]]))
        names = np.sort(rng.choice(pool, int(rng.integers(0, 600)), replace=False))
        common = names, rng.integers(8, 12, len(names))
        both = len(np.intersect1d(a, b))
        if both * 10 >= 8 * (len(a) + len(b) - both):
            seen += 1
            assert len(np.intersect1d(near_copies.prefix(a, 8, common), near_copies.prefix(b, 8, common)))
            apart = np.bitwise_count(near_copies.parity_print(a) ^ near_copies.parity_print(b)).sum()
            wide = near_copies.print_distance(*(near_copies.parity_print(x, near_copies.wide_longs(len(x))) for x in (a, b)))
            assert max(apart, wide) <= len(a) + len(b) - 2 * both <= near_copies.most_apart(np.array([len(a)]), np.array([len(b)]), 8)[0]
    assert seen > 500


def test_candidates_are_all_pairs_of_parted_components(spark):
    """Every pair of two components that shares a token is given, whatever the component sizes; pairs of one component aren't."""
    from plexus.llm import near_copies

    rng = np.random.default_rng(7)
    rows = sorted({(int(t), int(c)) for t, c in zip(rng.integers(0, 12, 700), rng.integers(0, 120, 700), strict=True)})
    of = {c: c if c < 30 else c % 5 + 200 for c in range(120)}
    made = spark.createDataFrame([(t, c, of[c], 10, [0] * near_copies.LONGS) for t, c in rows], "token long, class long, component long, n long, prints array<long>")
    got = sorted(map(tuple, near_copies.candidates(made, 8, 3).collect()))
    assert got == sorted({(a, b) for t, a in rows for u, b in rows if t == u and a < b and of[a] != of[b]})
    one = near_copies.candidates(made.withColumn("component", F.lit(0).cast("long")), 8, 3)
    assert one.count() == 0


def test_candidates_nearest_and_places(spark):
    """Forests connect what all pairs connect, by fewer pairs than components; places that can't be a first shared hash rule out."""
    from plexus.llm import near_copies

    rng = np.random.default_rng(9)
    rows = sorted({(int(t), int(c)) for t, c in zip(rng.integers(0, 12, 700), rng.integers(0, 120, 700), strict=True)})
    kind = "token long, class long, component long, n long, prints array<long>, place int"
    made = lambda place: spark.createDataFrame([(t, c, c // 2, 10, [c % 4] * near_copies.LONGS, place) for t, c in rows], kind)
    every, few = ([(r.a // 2, r.b // 2) for r in near_copies.candidates(made(0), 8, 1, x).collect()] for x in (False, True))
    assert smallest(60, every) == smallest(60, few) and len(few) < 60 < len(every)
    assert near_copies.candidates(made(1), 8, 3).count() == near_copies.candidates(made(0), 8, 3).count()  # 2 apart of 20 may be
    assert near_copies.candidates(made(2), 8, 3).count() == 0


def test_pairs_of_a_group_of_near_copies(spark, monkeypatch):
    """Copies of a text, most of whose pairs are less alike than 0.8, are joined by pairs that don't grow with the group's square."""
    from plexus.llm import near_copies

    rng, tried = random.Random(12), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    texts = [" ".join(word() if rng.random() < p else w for w in base) for p in (0.005, 0.015, 0.02, 0.03) for _ in range(150)]
    plain = near_copies.filtered
    monkeypatch.setattr(near_copies, "filtered", lambda pairs, *rest: tried.append(pairs.count()) or plain(pairs, *rest))
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(plain_near(texts)))
    assert sum(tried) < 10 * len(texts), tried


def test_vantage_point_blocks():
    """Blocks of wide prints differ like the angle of the sets; forests connect what their links connect, by the least."""
    rng = np.random.default_rng(2)
    from plexus.llm import near_copies

    away = []
    for _ in range(60):
        both = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 125, dtype=np.uint64)])) for _ in range(2))
        away.append(np.bitwise_count(near_copies.wide_print(a) ^ near_copies.wide_print(b)).sum())
    assert abs(np.mean(away) / 512 - near_copies.share_apart(0.8)) < 0.01
    for _ in range(20):
        a, b, w = rng.integers(0, 40, 200), rng.integers(0, 40, 200), rng.integers(0, 9, 200)
        a, b, w = a[a != b], b[a != b], w[a != b]
        x, y, z = near_copies.spanning(a, b, w)
        assert len(x) < 40
        for most in range(9):
            assert smallest(40, zip(a[w <= most].tolist(), b[w <= most].tolist(), strict=True)) == smallest(40, zip(x[z <= most].tolist(), y[z <= most].tolist(), strict=True))


def test_near_dedup_by_row(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "other words that stand for their own"), (8, "x y z x y z u"), (8, "x y z x y z u"), (None, "alone without an id here")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([rows[2], rows[3], rows[4], rows[6]], key=repr)


# -- 4


def test_pack():
    rng = random.Random(1)
    caps = [8, 16, 32]
    for _ in range(30):
        sizes = [rng.randint(1, 32) for _ in range(rng.randint(1, 60))]
        where, start, ends, cost = packing.pack(sizes, caps, 2.0)
        for b, end in enumerate(ends):
            spans = sorted((start[i], start[i] + sizes[i]) for i in range(len(sizes)) if where[i] == b)
            assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= end
            assert end == min(c for c in caps if c >= spans[-1][1])
        assert cost == sum(ends) + 2.0 * len(ends) and cost <= min(slow_pack(sizes, caps, least, 2.0) for least in caps)


def slow_pack(sizes, caps, least, price):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if b[0] - b[1] >= s]
        b = min(fits, key=lambda b: b[0] - b[1]) if fits else [min(c for c in caps if c >= max(s, least)), 0]
        if not fits:
            bins.append(b)
        b[1] += s
    return sum(min(c for c in caps if c >= b[1]) + price for b in bins)


def test_pack_documents(spark, odd, none):
    got = packing.pack_documents(odd, capacities=(64, 1024), group_rows=4).toPandas()
    assert got.groupby("bin")["size"].sum().equals(got.groupby("bin")["filled"].first().rename("size"))
    assert got[got["doc_id"] == 5]["size"].sum() == 9001 and len(got[got["doc_id"].isna()]) == 1 and (got["filled"] <= got["capacity"]).all()
    assert packing.pack_documents(none).count() == 0


def test_packing_equals_plain(spark):
    """The whole operator against a plain one: groups by the same hash, each packed by the slow rule; hot rows are dealt out."""
    rows = [(i, i * 37 % 90 + 1) for i in range(300)] + [(None, 10)] * 400 + [(5, 10)] * 70 + [(1000, 6400)]
    docs = spark.createDataFrame(rows, "doc_id long, n long")
    got = packing.pack_documents(docs, capacities=(16, 32, 64), size=F.col("n"), group_rows=64).toPandas()
    want = [(k, p, 64 * p, min(64, n - 64 * p)) for k, n in rows for p in range(-(-n // 64))]
    made = packing.pack_documents(docs, capacities=(16, 32, 64), size=F.col("n"), group_rows=64).select("doc_id", "piece", "start", "size").collect()
    assert sorted(map(repr, map(tuple, made))) == sorted(map(repr, want))
    assert (got.groupby("bin")["size"].sum() == got.groupby("bin")["filled"].first()).all() and got["bin"].str.split("-").str[0].value_counts().max() < 400
    for _, part in got.groupby(got["bin"].str.split("-").str[0]):
        ends = part.groupby("bin")["capacity"].first()
        sizes = part.sort_values(["doc_id", "piece", "size"], kind="stable")["size"].tolist()
        assert ends.sum() + 64.0 * len(ends) == min(slow_pack(sizes, [16, 32, 64], least, 64.0) for least in (16, 32, 64))
    again = packing.pack_documents(docs.repartition(9), capacities=(16, 32, 64), size=F.col("n"), group_rows=64).toPandas()
    assert sorted(map(repr, again.values.tolist())) == sorted(map(repr, got.values.tolist()))


# -- 5


def test_warc_of_crowded_keys(spark, tmp_path):
    """Keys that crowd, one key and null with a third of the rows each: every shard is a task's worth, and all comes back."""
    rows = [(10**15, "u", "x" * 50)] + [(i % 7 + 5, "u", f"p{i}" * 20) for i in range(400)] + [(None, "u", f"n{i}" * 20) for i in range(300)] + [(6, "u", f"q{i}" * 20) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/a", least_shards=16)
    sizes = manifest.groupBy("shard").agg(F.sum("records").alias("n")).toPandas()["n"]
    assert sizes.sum() == len(rows) and sizes.max() < 200
    got = warc.read_archives(spark, f"file://{tmp_path}/a", texts=True).collect()
    assert sorted((str(r.page_id), bytes(r.payload).decode()) for r in got if r.payload is not None) == sorted((str(i), t) for i, _, t in rows)
    again = warc.write_archives(pages.repartition(11), f"file://{tmp_path}/b", least_shards=16)
    assert sorted(map(tuple, manifest.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)


def test_warc(spark, tmp_path):
    long = "é" * 200_000
    rows = [(1, "http://a/ b", "<p>x</p>", 5), (2, None, "<p>x</p>", 5), (3, "u", None, 5), (4, "u", "", 5), (5, "u", long, 5), (5, "u", long, 5), (None, "u", "<p>x</p>", 5), (None, "u", "last", 5), (-7, "u", "r\r\n\r\nn", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size int")
    folder = f"file://{tmp_path}/a"
    manifest = warc.write_archives(pages, folder, file_bytes=300)
    got = warc.read_archives(spark, folder, texts=True).collect()
    assert manifest.agg(F.sum("records")).first()[0] == len(got) == len(rows)
    want = sorted([(-7, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (5, "revisit", 5), (None, "revisit", 1), (None, "response", None)], key=repr)
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=repr) == want
    texts = {(r.page_id, r.payload_digest): r for r in got if r.payload is not None}
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        if r := texts.get((page_id, warc.digest32(data))):
            assert bytes(r.payload) == data and r.payload_bytes == len(data)
    again = warc.write_archives(pages.repartition(5), f"file://{tmp_path}/b", file_bytes=300)
    assert sorted(map(tuple, manifest.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)
    assert not [p for p in (tmp_path / "a").iterdir() if p.name.startswith("_temporary")]
    assert warc.write_archives(pages.limit(0), f"file://{tmp_path}/c").count() == 0 == warc.read_archives(spark, f"file://{tmp_path}/c").count()


# -- 6 and 9


@pytest.mark.parametrize(("name", "label", "least"), [("op6_toxicity", "toxic", 0.9), ("op9_quality_classifier", "quality", 0.97)])
def test_classifiers(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"])
    assert (got["predicted"] == got[label]).mean() >= least and got["score"].between(0, 1).all()
    clean = got[got[label] == 0] if label == "toxic" else got[got[label] == 1]
    assert (clean["predicted"] == clean[label]).mean() >= 0.98


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_classifiers_odd(spark, odd, none, labels, score):
    got = score(odd, labels, keep=["doc_id", "extra", "size"]).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert score(none, labels).count() == 0 and score(odd, labels.limit(0)).count() == odd.count()


@pytest.fixture(scope="module")
def gauge():
    """Fitted on rows of sf0.1 that are not held out, and the held-out rows."""
    sf = "/root/testdata/sf0.1"
    rows = pd.read_parquet(f"{sf}/documents.parquet").merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id").dropna(subset=["toxic"]).sort_values("doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in rows["doc_id"]])
    return toxicity.fit([(t or "", int(y)) for t, y in zip(rows["text"][~held], rows["toxic"][~held], strict=True)]), rows[held]


def test_toxic_marks_of_all_languages(gauge):
    tool, rows = gauge
    caught = np.array([tool.score(t or "") >= 0.7 for t in rows["text"]])
    assert caught[rows["toxic"] == 0].mean() <= 0.02
    for lang in ("de", "en", "es", "fr"):
        assert caught[(rows["toxic"] == 1) & (rows["lang"] == lang)].mean() >= 0.4


def test_toxic_passage_in_long_text(gauge):
    tool, rows = gauge
    english = rows[rows["lang"] == "en"]
    clean = [t for t in english["text"][english["toxic"] == 0] if tool.score(t) < 0.7][:100]
    bad = [t for t in english["text"][english["toxic"] == 1] if tool.score(t) >= 0.7][:25]
    for k in (1, 10, 100):
        half = " ".join(clean[: k // 2])
        assert np.mean([tool.score(f"{half} {t} {' '.join(clean[k // 2 : k])}") >= 0.7 for t in bad]) >= 0.9


# -- 7


def signed(x):
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def plain_winnow(text, k, w, word, longest=16):
    """(hash, position) of each window's least gram, the rightmost of equals; ``word`` has the hash of each piece and of short lists."""
    pieces = [p for run in re.findall(r"[^\x20\x09-\x0D]+", text) for p in ([run] if len(run) <= longest else run)]
    if not pieces:
        return []
    if len(pieces) <= k:
        grams = [word[tuple(pieces)]]
    else:
        turn = lambda x, n: (x << n | x >> 64 - n) & (1 << 64) - 1 if n else x
        own = [word[p] & (1 << 64) - 1 for p in pieces]
        grams = []
        for i in range(len(own) - k + 1):
            value = 0
            for j in range(k):
                value ^= turn(own[i + j], k - 1 - j)
            grams.append(signed(value))
    kept = {min(range(i, min(i + w, len(grams))), key=lambda p: (grams[p], -p)) for i in range(max(1, len(grams) - w + 1))}
    return [(grams[p], p) for p in sorted(kept)]


def piece_hashes(spark, texts):
    """Hashes by the engine's own function of pieces alone; all else is worked out by the test."""
    some = {p for t in texts for run in re.findall(r"[^\x20\x09-\x0D]+", t) for p in ([run] if len(run) <= 16 else run)}
    return {r.p: r.h for r in spark.createDataFrame([(p,) for p in sorted(some)], "p string").select("p", F.xxhash64("p").alias("h")).collect()}


def short_hashes(spark, texts, word, k):
    out = {}
    for t in texts:
        pieces = tuple(p for run in re.findall(r"[^\x20\x09-\x0D]+", t) for p in ([run] if len(run) <= 16 else run))
        if 0 < len(pieces) <= k:
            out[pieces] = [word[p] for p in pieces]
    if not out:
        return {}
    rows = spark.createDataFrame([(list(p), h) for p, h in out.items()], "p array<string>, h array<long>")
    return {tuple(r.p): r.h for r in rows.select("p", F.xxhash64("h").alias("h")).collect()}


@pytest.mark.parametrize(("k", "w"), [(5, 8), (3, 4), (1, 1), (7, 5), (2, 3), (8, 16)])
def test_winnow(spark, k, w):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 12, 13, 40, 200)] + ["y" * 100, "é 漢" * 30, "a a a a a a a a a a a a a a a a a a a a", "漢字" * 20 + " x"]
    word = piece_hashes(spark, texts)
    word |= short_hashes(spark, texts, word, k)
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", winnowing.winnow(F.col("t"), k, w).alias("f"))
    for r in df.select("t", "f.hash", winnowing.positions(F.col("f")).alias("p")).collect():
        assert list(zip(r.hash, r.p, strict=True)) == plain_winnow(r.t, k, w, word)


def test_shared_runs_are_found(spark):
    rng = random.Random(5)
    run = "".join(rng.choice("天地玄黄宇宙洪荒") for _ in range(60))
    texts = ["前" * n + run + "後" * 30 for n in (20, 21, 33)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(winnowing.hashes(winnowing.winnow(F.col("t"))).alias("h")).collect()
    assert all(set(a.h) & set(b.h) for a in rows for b in rows)


def test_edited(spark, odd, none):
    """All columns of the query against the plain fingerprint."""
    got = {r.doc_id: r for r in winnowing.edited_fingerprints(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    texts, edited = [t or "" for t in ODD], []
    for i, t in enumerate(texts):
        q = len(t) // 4
        edited.append(t[: len(t) - q] + texts[(i + 1) % len(texts)][:q])
    word = piece_hashes(spark, texts + edited)
    word |= short_hashes(spark, texts + edited, word, 5)
    prints = [plain_winnow(t, 5, 8, word) for t in texts + edited]
    like = lambda a, b: 1.0 if not (a or b) else len({h for h, _ in a} & {h for h, _ in b}) / len({h for h, _ in a} | {h for h, _ in b})
    for i, t in enumerate(texts):
        r, other = got[i], len(texts) + i
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(prints[i], prints[other])) and r.near_next == pytest.approx(like(prints[i], prints[(i + 1) % len(texts)]))
        for j in range(len(texts)):
            assert (r.fingerprint == got[j].fingerprint) == (prints[i] == prints[j]) and (r.edited_fingerprint == got[j].fingerprint) == (prints[other] == prints[j])
    assert got[8].fingerprint == got[9].fingerprint and got[8].near_next == 1
    assert winnowing.edited_fingerprints(odd).count() == odd.count() and winnowing.edited_fingerprints(none).count() == 0
    with pytest.raises(TypeError):
        winnowing.edited_fingerprints(odd.withColumn("doc_id", F.lit("a")))


def test_next_over_buckets(spark):
    rows = [(i * i * 7 % 1009 - 300, str(i)) for i in range(500)]
    got = winnowing.with_next(spark.createDataFrame(rows, "doc_id long, text string"), rows=20).select("doc_id", "_text", "next._text").collect()
    line = sorted(rows)
    assert sorted(map(tuple, got)) == sorted((a[0], a[1], b[1]) for a, b in zip(line, line[1:] + line[:1], strict=True))


# -- 8


def test_water_fill(spark):
    rng = random.Random(2)
    for _ in range(6):
        rows = [(i, rng.choice([0, 5, 40, 1000, 70_000]) + rng.randrange(50), [5.0, 2.0, 1.0][i % 3]) for i in range(rng.randint(1, 12))]
        got = {r.i: r.target for r in mixing.water_fill(spark.createDataFrame(rows, "i int, source_size long, weight double"), 1.5, 2).collect()}
        left, open_, want = 1.5 * sum(r[1] for r in rows), dict((r[0], r) for r in rows), {}
        while open_:
            total = sum(r[2] for r in open_.values())
            over = [i for i, r in open_.items() if left * r[2] / total >= 2 * r[1]]
            if not over:
                want |= {i: left * r[2] / total for i, r in open_.items()}
                break
            for i in over:
                want[i] = 2.0 * open_[i][1]
            left -= sum(2.0 * open_.pop(i)[1] for i in over)
        assert got == pytest.approx(want)


def test_mix(spark, odd, none):
    got = mixing.mix(odd, keep=["text"]).toPandas()
    again = mixing.mix(odd.repartition(7), keep=["text"]).toPandas()
    assert len(got) == odd.count() and sorted(map(repr, got.values.tolist())) == sorted(map(repr, again.values.tolist()))
    assert (got["taken"] <= 2 * got["size"]).all() and mixing.mix(none).count() == 0
    big = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"))
    for r in big.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect():
        assert abs(r.t - r.g) <= r.m


@pytest.mark.parametrize("keep", [(), ("text", "extra")])
def test_mix_of_equal_rows(spark, keep, tmp_path):
    ten = " ".join("abcdefghij")
    cases = {
        "equal": [(7, ten, "a", "x")] * 1000,
        "null ids": [(None, ten, "a", str(i % 40)) for i in range(500)] + [(i, ten, "a", "x") for i in range(500)],
        "two sources": [(None, " ".join("w" * (i % 9)), "ab"[i % 3 == 0], "x") for i in range(900)] + [(5, ten, "b", "y")] * 300,
    }
    for name, rows in cases.items():
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string")
        got = mixing.mix(docs, keep=keep).toPandas()
        again = mixing.mix(docs.repartition(7), keep=keep).toPandas()
        assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
        assert sorted(map(repr, got.values.tolist())) == sorted(map(repr, again.values.tolist()))
        for _, part in got.groupby("source"):
            assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max()
        if not keep:
            docs.write.parquet(f"{tmp_path}/{len(name)}")
            con = duckdb.connect()
            con.execute(f"create view documents as select * from '{tmp_path}/{len(name)}/*.parquet'")
            want = con.execute(mixing.OP8_SQL).df()[["doc_id", "size", "source_size", "target", "taken"]]
            assert sorted(map(repr, want.astype(float).values.tolist())) == sorted(map(repr, got[list(want.columns)].astype(float).values.tolist()))


# -- 10


def test_tokens(spark, odd, none):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = pd.read_parquet(f"{SF}/documents.parquet")["text"].tolist() + [t or "" for t in ODD] + ["a\x1cb !\x1f! Σ\x85ς ſİ  <|startoftext|>x", "it's WE'LL", "１²٣ ǅ한漢😀é"]
    counter = token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"), max_words=500)
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in tool.encode_batch(texts, add_special_tokens=False)]
    points = [f"a{c}b!{c}! 1{c}2" for x in range(0x20000) if not 0xD800 <= x < 0xE000 for c in (chr(x),)]
    assert [counter.count(t) for t in points] == [len(e.ids) for e in tool.encode_batch(points, add_special_tokens=False)]
    got = token_counts.count_tokens(odd, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {0} and {r.over_limit for r in got if r.doc_id == 5} == {True}
    assert token_counts.count_tokens(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


# -- the pipeline


def test_pipeline(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), None
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        after = docs.toPandas()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality":
            gone = set(before["doc_id"]) - set(after["doc_id"])
            assert all(truth[i].quality == 0 for i in gone if i in truth)
        if name == "toxicity":
            gone = before[~before["doc_id"].isin(after["doc_id"])]
            model = toxicity.fit(common.labelled_sample(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), "toxic", {1: 1200, 0: 3000}))
            assert set(gone["doc_id"]) == {i for i, t in zip(before["doc_id"], before["text"], strict=True) if model.score(t or "") >= 0.7}
        if name == "near_dedup":
            group = plain_near(before["text"].tolist())
            assert set(after["doc_id"]) == set(before.groupby(pd.Series(group, before.index))["doc_id"].min())
        if name == "mixing":
            kept = after.groupby("doc_id").size()
            assert kept.max() <= 2 and set(after["doc_id"]) <= set(before["doc_id"])
            share = after["text"].str.split().str.len().sum() / before["text"].str.split().str.len().sum()
            assert 1.4 < share < 1.6
        if name == "packing":
            assert after[after["piece"] == 0].groupby("doc_id").size().equals(kept)


def test_pipeline_odd(spark, odd, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, f"file://{tmp_path}").count() >= 0
