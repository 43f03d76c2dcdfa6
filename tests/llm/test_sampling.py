"""Resampling, clustering and mixing against plain versions and against the statements for DuckDB."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from ledgerline.llm import centroids, mixing, registry, resample

r = random.Random(7)
WORDS = ["".join(r.choice("abcdeéñß9") for _ in range(r.randint(1, 8))) for _ in range(300)]


def prose(n, seed):
    x = random.Random(seed)
    return " ".join(x.choice(WORDS) for _ in range(n))


TEXTS = [None, "", " \t\n", "one", "One-two_three ÉÉ", prose(19, 1), prose(20, 2), prose(20, 2), prose(9000, 3), "x" * 5000, "a\x00b\x1fc", *[prose(10 + i, i) for i in range(60)]]
SOURCES = [None, "b", "a", "é", "A", "zz", ""]
ROWS = [(i, t, SOURCES[i * i % 7 % len(SOURCES)], 1, 1) for i, t in enumerate(TEXTS)] + [(7, prose(30, 5), "a", 1, 1)] * 3 + [(None, prose(25, 6), "b", 1, 1), (None, prose(26, 7), None, 1, 1), (99, None, "empty", 1, 1)]
EXTRA = "n long, rank long, h long, size long, no long, weight long, _row long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, *[k] * 7) for i, t, s, k, _ in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {EXTRA}").repartition(3)


def same_as_duckdb(sql, name, rows, con):
    rel = con.sql(sql)
    columns = sorted(rel.columns)
    tidy = lambda x: sorted((tuple(round(v, 6) if isinstance(v, float) else str(v) for v in row) for row in x), key=str)
    assert tidy(tuple(x[c] for c in columns) for x in rows) == tidy(rel.select(", ".join(columns)).fetchall()), name


def files(spark, tmp, **tables):
    """A folder of tables, and DuckDB over it."""
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{tmp}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp}/{name}.parquet/*.parquet'")
    return con


# -- resampling


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def features(t, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, longest, buckets, share, least):
    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(f % buckets for f in features(text, longest)[1])
    for text in target:
        t.update(f % buckets for f in features(text, longest)[1])
    out, who = [], []
    for i, text in rows:
        n, f = features(text, longest)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in (x % buckets for x in f)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        who += [len(out) - 1] * (n >= least)
    who.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0, out[k][1]))
    for rank, k in enumerate(who[: len(who) * share // 100], 1):
        out[k][4] = rank
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (2, 97), (3, 65_536)])
def test_resample(spark, docs, longest, buckets):
    target = spark.createDataFrame([(prose(40, 3), 1), (None, 2), ("", 3)], "text string, doc_id int")
    got = resample.resample(docs, target, longest=longest, buckets=buckets, share=30)
    want = plain_resample([(i, t) for i, t, *_ in ROWS], [prose(40, 3)], longest, buckets, 30, 20)
    assert sorted((tuple(x) for x in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == want
    assert max(x[4] or 0 for x in want) == sum(x[4] is not None for x in want) > 10


def test_drawn_documents_are_those_of_the_target(spark):
    here, there = [prose(60, i) for i in range(80)], ["zulu yankee xray " * 20] * 20
    docs = spark.createDataFrame(list(enumerate(here + there)), "doc_id long, text string")
    got = resample.drawn(docs, spark.createDataFrame([("xray zulu yankee",)] * 4000, "text string"), share=20)
    ids = [x.doc_id for x in got.collect()]
    assert len(ids) == 20 and sum(i >= 80 for i in ids) >= 17 and got.columns == docs.columns  # a draw: the noise lets a few others in


def test_crc_of_spans():
    data = np.frombuffer("".join(chr(r.randint(1, 300)) for _ in range(3000)).encode(), np.uint8)
    at = np.array(sorted(r.randint(0, len(data) - 200) for _ in range(300)))
    end = at + np.array([r.choice([0, 1, 3, 47, 48, 49, 200]) for _ in range(300)])
    assert resample.crc32_spans(data, at, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(at, end, strict=True)]
    assert [x.tolist() for x in resample.run_lengths(np.array([3, 1, 3, 0], "<u2"))] == [[0, 1, 3], [1, 1, 2]]


def test_op11(spark, docs, tmp_path):
    con = files(spark, tmp_path, documents=docs, benchmark=spark.createDataFrame([(1, prose(50, 3)), (2, None)], "item_id long, text string"))
    got = registry.queries()["op11_resample"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same_as_duckdb(registry.oracle_sql()["op11_resample"], "op11", got.collect(), con)


# -- clustering


def vectors(n=400, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, 64)).astype(np.float32).tolist()
    rows = [(i, v, 1) for i, v in enumerate(x)] + [(5, x[5], 1)] * 30 + [(None, x[9], 2), (None, x[10], 2)]
    return rows + [(900, None, 1), (901, [], 1), (902, x[0][:63], 1), (903, [*x[0][:63], None], 1), (904, [*x[0][:63], float("nan")], 1), (905, [*x[0][:63], float("inf")], None), (906, [0.0] * 64, None)]


VECTORS = "vec_id long, embedding array<float>, owner int, was string, q string"


def plain_clusters(rows, k, rounds):
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(q, key=lambda x: (hashlib.sha256(f"2:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))[:k]]
    for at in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, y, strict=True)), j) for j, y in enumerate(c)) for _, v in q]
        if at < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), o in zip(q, own, strict=True) if o[1] == j]
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else c[j]
    return sorted(((i, o[1], o[0]) for (i, _), o in zip(q, own, strict=True)), key=str), c


@pytest.mark.parametrize("k, rounds", [(7, 4), (40, 2), (1000, 1), (3, 0)])
def test_clusters(spark, k, rounds):
    rows = vectors(60)
    df = spark.createDataFrame([(*x, "w", "q") for x in rows], VECTORS).repartition(3)
    got, c = centroids.cluster(df, k, rounds)
    want, wanted = plain_clusters([x[:2] for x in rows], k, rounds)
    assert sorted((tuple(x) for x in got.select("vec_id", "cluster", "distance").collect()), key=str) == want and c.tolist() == wanted


def test_transfers_leave_the_sums_that_a_whole_sum_gives(spark):
    """What changed owner alone gives the sums of all: three rounds by hand."""
    df = spark.createDataFrame([(*x, "w", "q") for x in vectors(80)], VECTORS)
    rows = centroids.kept(df)
    x = np.array([y.q for y in rows.collect()])
    c, changed, done, total = centroids.first_centroids(rows, 6), np.ones(6, bool), None, np.zeros((6, 65), np.int64)
    for _ in range(3):
        done = centroids.materialize(centroids.assign(rows if done is None else done, c, changed, done is None), "t")
        for y in centroids.transfers(done, 6, 64).collect():
            total[y.cluster, y.dim + 1] += int(y.delta)
        owner = centroids.distances(x, c).argmin(1)
        assert total.tolist() == [[int((owner == j).sum()), *x[owner == j].sum(0).tolist()] for j in range(6)]
        now = np.array([t[1:] // t[0] if t[0] else old for t, old in zip(total, c, strict=True)])
        changed, c = (now != c).any(1), now
    assert done.where("NOT moved").count() > 0


def test_large_components_stay_exact(spark):
    big = np.array([[2**26, -(2**26)], [1, 2]], dtype=np.int64)
    assert centroids.distances(big, big).tolist() == [[int(sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True))) for y in big] for x in big]
    with pytest.raises(Exception, match="component"):
        centroids.kept(spark.createDataFrame([(1, [3e9] * 64)], "vec_id long, embedding array<float>")).collect()


def test_op12(spark, tmp_path):
    df = spark.createDataFrame([(*x, "w", "q") for x in vectors()], VECTORS)
    con = files(spark, tmp_path, embeddings=df)
    got = registry.queries()["op12_centroids"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same_as_duckdb(registry.oracle_sql()["op12_centroids"], "op12", got.collect(), con)


# -- mixing


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def plain_targets(rows, share, weights=(5, 2, 1), cap=3):
    have = collections.Counter()
    for _, t, s, *_ in rows:
        have[s] += size(t)
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(have, key=lambda s: (s is None, s or "")))}
    capped = set()
    while True:
        rest, open_ = sum(have.values()) * share / 100 - sum(cap * have[s] for s in capped), sum(w[s] for s in have if s not in capped)
        fair = {s: cap * have[s] if s in capped else rest * w[s] / open_ for s in have}
        more = {s for s in have if s not in capped and fair[s] > cap * have[s]}
        if not more:
            return have, fair
        capped |= more


@pytest.mark.parametrize("shares", [(100,), (5, 40, 100, 180, 300)])
def test_mix(spark, docs, shares):
    out = mixing.mix(docs, shares).collect()
    assert len(out) == len(ROWS) * len(shares)
    for share in shares:
        have, fair = plain_targets(ROWS, share)
        taken, largest = collections.Counter(), collections.Counter()
        for x in (x for x in out if x.share == share):
            assert x.source_size == have[x.source] and x.target == pytest.approx(fair[x.source]) and x.taken in [k * x.size for k in range(4)]
            taken[x.source] += x.taken
            largest[x.source] = max(largest[x.source], x.size)
        for s in have:
            assert abs(taken[s] - fair[s]) <= largest[s] / 2 + 1e-6
    by = collections.defaultdict(list)  # larger mixes hold the smaller ones
    for x in sorted(out, key=lambda x: x.share):
        by[x.doc_id, x.size, x.source].append((x.share, x.taken))
    for rows in by.values():
        sums = [sum(t for s, t in rows if s == share) for share in sorted(shares)]
        assert sums == sorted(sums)
    again = mixing.mix(docs.repartition(5), shares).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mix_of_equal_rows(spark):
    """A third of all rows are one row again and again: the mix still comes near the target."""
    rows = [(1, "a b c", "x")] * 400 + [(i, "d e", "x") for i in range(100)] + [(i, "f " * 50, "y") for i in range(100, 140)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), (40,)).collect()
    _, fair = plain_targets(rows, 40)
    for s in fair:
        assert abs(sum(x.taken for x in out if x.source == s) - fair[s]) <= 50 / 2
    assert len({x.taken for x in out if x.doc_id == 1}) == 2


def test_op13(spark, docs, tmp_path):
    con = files(spark, tmp_path, documents=docs)
    got = registry.queries()["op13_mix"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    same_as_duckdb(registry.oracle_sql()["op13_mix"], "op13", got.collect(), con)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert resample.resample(none, none.select("text")).count() == 0 and mixing.mix(none).count() == 0
    assert centroids.cluster(spark.createDataFrame([], VECTORS))[0].count() == 0
    assert {x.rank for x in resample.resample(docs, none.select("text"), share=0).collect()} == {None}
