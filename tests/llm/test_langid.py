import zlib

import numpy as np

from quizmill.llm.langid import STRIDE, WIDTHS, WINDOW, ByteNet, fit, identify, op9_language_id, windows


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_language_id(spark, sf).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_windows_cover_the_whole_text():
    w, n = windows("É" * 300 + "END")
    data = ("É" * 300 + "end").encode()
    assert w.shape == (3, WINDOW) and n.tolist() == [256, 253, 94] and sum(n) == 603
    assert all(row.tobytes() == data[k * STRIDE : k * STRIDE + WINDOW].ljust(WINDOW, b"\0") for k, row in enumerate(w))
    for size in (1, 3, 255, 256, 257, 508, 509, 510, 762, 763, 5000):
        w, n = windows("x" * size)
        assert n.sum() == size and (n > 0).all() and len(w) == len(n)
    assert len(windows(None)[0]) == len(windows("")[0]) == 0


def plain_predict(net, text):
    """Probabilities by the layers themselves, byte by byte: no tables, no strides."""
    data = (text or "").encode().lower()
    total, out, at = np.zeros(len(net.p["c"])), 0, 0
    while out < len(data):
        part = data[at : at + WINDOW]
        x = net.p["e"][list(part.ljust(WINDOW, b"\0"))].astype(float)
        h = []
        for w in WIDTHS:
            z = np.array([x[i : i + w].ravel() @ net.p[f"w{w}"] for i in range(WINDOW - w + 1)]) + net.p[f"b{w}"]
            h.append(z.max(axis=0))
        s = np.maximum(np.concatenate(h), 0) @ net.p["o"] + net.p["c"]
        s = np.exp(s - s.max())
        fresh = min(at + WINDOW, len(data)) - out
        total, out, at = total + fresh * s / s.sum(), out + fresh, at + STRIDE
    return total / len(data)


def test_predictions_against_plain_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    langs, net = fit(docs, "doc_id", "text", "lang")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    for d in sorted(texts, key=lambda d: len(texts[d] or ""))[::5]:
        if any(map(str.isalpha, texts[d] or "")) and len(texts[d]) < 30_000:
            p = plain_predict(net, texts[d])
            assert abs(got[d]["score"] - p.max()) < 1e-4 and (got[d]["lang_pred"] == langs[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-4)


def test_the_sample_is_bounded_and_reaches_the_ends_of_texts(spark, monkeypatch):
    from quizmill.llm import langid

    monkeypatch.setattr(langid, "SAMPLE", 40)
    seen = []
    monkeypatch.setattr(langid.ByteNet, "train", lambda self, x, y: seen.append((x.copy(), y)) or self)
    rows = [(k, "start " * 400 + "ending " * 400, "ab"[k % 2]) for k in range(60)]
    fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    x, y = seen[0]
    assert len(x) == 40 and (np.bincount(y) == 20).all()
    assert any(b"ending" in row.tobytes() for row in x) and any(b"start" in row.tobytes() for row in x)


def test_tables_agree_with_the_layers():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (50, WINDOW)).astype(np.uint8), rng.integers(0, 3, 50)
    net = ByteNet(3)
    net.tables()
    p = net.predict(x)
    step = 1e-3
    g = net.gradients(x, y)
    for name, at in (("o", (0, 1)), ("w3", (5, 2)), ("e", (int(x[0, 0]), 1))):
        loss = []
        for d in (step, -step):
            net.p[name][at] += d
            net.tables()
            loss.append(-np.log(net.predict(x)[np.arange(50), y].astype(float)).mean())
            net.p[name][at] -= d
        assert abs((loss[0] - loss[1]) / (2 * step) - g[name][at]) < 5e-3
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_nulls_ties_empty_and_extra_columns(spark):
    rows = [(k, ("the cat and the dog " if k % 2 else "der hund und die katze ") * 5, "ed"[k % 2 - 1]) for k in range(40)]
    rows += [(50, None, "e"), (51, "", None), (52, "123 ... !", "e"), (53, "漢字", None), (None, "the cat", "e"), (54, "der hund " * 20000, None), (1, rows[1][1], "e")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, lang string, k string, w int")
    got = identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by[k] for k in (50, 51, 52)] == ["und"] * 3 and by[54] == "d" and by[None] == "e" and by[53] in "ed"
    assert {r["lang_pred"] for r in identify(docs.where("lang is null")).collect()} == {"und"}
    assert identify(docs.limit(0)).collect() == []
