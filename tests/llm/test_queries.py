"""The registered queries on a folder of small tables, against plain versions: columns, digests and order of spans."""

import collections
import hashlib

import numpy as np
import pytest
from test_llm_operators import by_id, docs, groups, pii_base, rows_by_id, secret_base, shingle_set  # noqa: F401

from ledgerline.llm import bpe, registry

LAST = 10**6  # stands for the row without an id


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):  # noqa: F811
    top = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{top}/documents.parquet")
    x = np.random.default_rng(8).normal(size=(40, 16))
    near = [x[i % 6] + 0.05 * np.random.default_rng(i).normal(size=16) for i in range(60)]
    rows = [(i, v.astype(np.float32).tolist(), i % 3 if i < 90 else None) for i, v in enumerate([*x, *near])] + [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, x[0].astype(np.float32).tolist(), 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{top}/embeddings.parquet")
    return str(top)


def digest(spans):
    return hashlib.sha256(",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans).encode()).hexdigest()


@pytest.mark.parametrize("name, base, kinds", [("op1_pii", pii_base, ("email", "ip", "card", "phone")), ("op3_secrets", secret_base, ("assign", "access", "hex"))])
def test_spans(spark, folder, name, base, kinds):
    out = registry.queries()[name](spark, folder)
    assert out.columns[: len(kinds) + 3] == ["doc_id", *[f"n_{k}" for k in kinds], "base_sha256", "spans"]
    got = rows_by_id(out)
    assert {i: len(r) for i, r in got.items()} == {i: 2 if i == 7 else 1 for i in by_id}
    for i, rows in got.items():
        for r in rows:
            want = base(by_id[i] or "")
            assert r.base_sha256 == digest(want) and [r[f"n_{k}"] for k in kinds] == [sum(s[3] == k for s in want) for k in kinds]
            spans = [(int(s), kinds.index(k), int(e), k) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
            assert spans == sorted(spans) and set(want) <= set(spans)


def test_op5(spark, folder):
    rows = {r.vec_id: r for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    good = {i: np.array(r.embedding, float) for i, r in rows.items() if r.embedding and r.label is not None and np.isfinite(r.embedding).all() and np.any(r.embedding)}
    linked = lambda a, b: a != b and a in good and b in good and rows[a].label == rows[b].label and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.98
    root = groups(list(rows), linked)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in registry.queries()["op5_vectors"](spark, folder).collect()}
    assert got == {i: (sum(linked(i, j) for j in rows), root[i], root[i] == i) for i in rows} and sum(n for n, _, _ in got.values()) > 40


def test_op7(spark, folder):
    data = [(i, (t or "").encode()) for i, t in by_id.items()] + [(7, (by_id[7] or "").encode())]
    seen = collections.Counter(b[k : k + 400] for _, b in data for k in range(len(b) - 399))
    want = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = registry.queries()["op7_repeats"](spark, folder).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and sum(w[2] for w in want) > 1000


def test_op8(spark, folder):
    sets = {LAST if i is None else i: shingle_set(t) for i, t in by_id.items()}
    root = groups(list(sets), lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    for i, rows in rows_by_id(registry.queries()["op8_jaccard"](spark, folder).select("doc_id", "n_shingles", "component_id")).items():
        k = LAST if i is None else i
        assert {tuple(r) for r in rows} == {(i, len(sets[k]), None if root[k] == LAST else root[k])} and len(rows) == 1 + (i == 7)


def test_op10(spark, folder):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.public_path())
    whole.no_padding()
    whole.no_truncation()
    hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, rows in rows_by_id(registry.queries()["op10_bpe"](spark, folder)).items():
        ids = whole.encode(by_id[i] or "", add_special_tokens=False).ids
        assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {(len(ids), hexed(" ".join(map(str, ids))), hexed(whole.decode(ids, skip_special_tokens=False)))}
