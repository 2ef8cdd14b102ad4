import hashlib
import math

import numpy as np
import pytest
from helpers import duck, normal

from quizmill.llm.vectorcodes import ENTRIES, OP11_SQL, ROUNDS, encode_vectors, nearest, op11_vector_codes


def plain(rows):
    """(vec_id, code, error, label_error, digest) by loops over Python's whole numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][1]) // 4
    parts = [[tuple(v[p * w : (p + 1) * w]) for _, v, _ in kept] for p in range(4)]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0], kept[k][1]))[:ENTRIES]
    books = [[parts[p][k] for k in first] for p in range(4)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))
    for r in range(ROUNDS + 1):
        near = [[best(x, books[p]) for x in parts[p]] for p in range(4)]
        for p in range(4):
            for j in range(len(books[p])):
                own = [x for x, (_, at) in zip(parts[p], near[p], strict=True) if at == j]
                if own and r < ROUNDS:
                    books[p][j] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(near[p][k][0] for p in range(4)) for k in range(len(kept))]
    of = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        of[lab] = of.get(lab, 0) + e
    return [(i, "".join(f"{near[p][k][1]:02x}" for p in range(4)), errors[k], of[lab], digest) for k, (i, _, lab) in enumerate(kept)]


def test_nearest_is_exact_where_float32_is_not():
    rng = np.random.default_rng(0)
    entries = rng.integers(-(2**24), 2**24, (64, 8))
    entries[40] = entries[7]  # a tie
    x = np.concatenate([entries[rng.integers(0, 64, 500)] + rng.integers(-1, 2, (500, 8)), np.repeat((entries[:1] + entries[1:2]) // 2, 5, axis=0)])
    exact = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(-1)
    at, distance = nearest(x, entries)
    assert (at == [int(np.argmin(r)) for r in exact]).all() and (distance == exact.min(axis=1)).all()
    assert not (at == 40).any()


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert normal(op11_vector_codes(spark, sf).toPandas()).equals(normal(duck(sf).execute(OP11_SQL).df()))


@pytest.mark.parametrize("n", [5, 330])
def test_same_as_loops(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(k), [float(np.float32(x)) for x in rng.normal(size=8) / 4], int(k) % 3 if k % 7 else None) for k in rng.permutation(n)]
    rows += [(2, [0.25] * 8, 1), (2, [0.25] * 8, 1), (3, [-0.0005] * 8, None), (None, [0.1] * 8, 1), (n + 1, None, 0), (n + 2, [1.0, None] * 4, 0), (n + 3, [float("nan")] * 8, 0), (n + 4, [float("inf")] * 8, 0)]
    frame = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<float>, label int, of int, code string, fits double").repartition(3)
    got = sorted(map(tuple, encode_vectors(frame).collect()), key=str)
    assert got == sorted(plain(rows), key=str)


def test_other_lengths_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    frame = spark.createDataFrame([(0, [0.5] * 4, 1), (1, [0.25] * 4, 1), (2, [0.5] * 8, 1), (3, [0.5], 2), (4, [], None)], schema)
    got = {r["vec_id"]: r for r in encode_vectors(frame).collect()}
    assert [got[k]["code"] for k in range(5)] == ["00000000", "01010101", None, None, None]
    assert got[0]["error"] == got[1]["label_error"] == 0 and got[2]["error"] is None and got[3]["label_error"] is None
    assert encode_vectors(frame.limit(0)).collect() == []
    assert encode_vectors(frame.where("vec_id > 2")).select("code").distinct().collect()[0]["code"] is None


def test_components_too_large_for_64_bits_are_refused(spark):
    frame = spark.createDataFrame([(0, [1e300] * 4, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="too large"):
        encode_vectors(frame)
