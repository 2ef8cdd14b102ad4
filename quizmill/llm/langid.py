"""Language identification by a convolutional network over bytes, trained in numpy.

Bytes are embedded; filters of several widths run over fixed-length windows, each filter's maximum over the window goes to a
softmax. A document is read to its end in windows that overlap by one byte less than the widest filter, so that every filter sees every place,
and their probabilities are averaged by bytes. At prediction the embedding and a filter's weights for two neighbouring bytes are one table look-up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import held_out
from .stage import sliced, table, written

WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)
STRIDE = WINDOW - max(WIDTHS) + 1
#: The bound of the sample that trains the network: so many windows, shared evenly by the languages but at most LANGUAGE for each, chosen by hash from all windows of all texts.
SAMPLE, LANGUAGE = 32_768, 3200
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.004, 11


def windows(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a whole text (zero-padded, A-Z lower-cased) and the bytes in each that no earlier one has."""
    data = np.frombuffer((text or "").encode().lower(), np.uint8)
    n = max(-(-(len(data) - WINDOW) // STRIDE), 0) + 1 if len(data) else 0
    padded = np.zeros(n * STRIDE + WINDOW - STRIDE, np.uint8)
    padded[: len(data)] = data
    sizes = np.full(n, STRIDE)
    if n:
        sizes[0] = WINDOW
        sizes[-1] += len(data) - sizes.sum()
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE][:n] if n else np.zeros((0, WINDOW), np.uint8), sizes


class ByteNet:
    def __init__(self, classes: int):
        rng = np.random.default_rng(SEED)
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["o"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes))
        self.p["c"] = np.zeros(classes)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        emb, pooled, at = p["e"][x], [], {}
        for w in WIDTHS:
            cols = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * EMBED)
            z = cols @ p[f"w{w}"] + p[f"b{w}"]
            at[w] = (z.argmax(axis=1), cols)
            pooled.append(z.max(axis=1))
        h = np.maximum(np.hstack(pooled), 0)
        s = h @ p["o"] + p["c"]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        s[np.arange(n), y] -= 1
        s /= n
        g = {"o": h.T @ s, "c": s.sum(axis=0), "e": np.zeros_like(p["e"])}
        dh = (s @ p["o"].T) * (h > 0)
        rows = np.arange(n)[:, None]
        for k, w in enumerate(WIDTHS):
            d = dh[:, k * FILTERS : (k + 1) * FILTERS]
            best, cols = at[w]
            g[f"w{w}"] = np.einsum("nf,nfc->cf", d, cols[rows, best])
            g[f"b{w}"] = d.sum(axis=0)
            back = np.einsum("nf,cf->nfc", d, p[f"w{w}"]).reshape(n, FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(g["e"], x[rows, best + j], back[:, :, j])
        return g

    def train(self, x: np.ndarray, y: np.ndarray) -> ByteNet:
        """Adam on shuffled batches; classes weigh the same in total."""
        rng, t = np.random.default_rng(SEED + 1), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        share = 1 / np.bincount(y, minlength=len(self.p["c"])).clip(1)
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            pick = rng.choice(len(x), len(x), p=share[y] / share[y].sum())
            for a in range(0, len(x), BATCH):
                part, t = pick[a : a + BATCH], t + 1
                for k, g in self.gradients(x[part], y[part]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> None:
        """Look-up tables of two bytes for each part of each filter."""
        self.lookup = {}
        first, second = np.arange(1 << 16) >> 8, np.arange(1 << 16) & 255
        for w in WIDTHS:
            one = [self.p["e"] @ self.p[f"w{w}"][j * EMBED : (j + 1) * EMBED] for j in range(w)]
            self.lookup[w] = [(j, np.ascontiguousarray(one[j][first] + one[j + 1][second])) if j + 1 < w else (j, one[j]) for j in range(0, w, 2)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window."""
        out = []
        for a in range(0, len(x), 32):
            part = x[a : a + 32]
            two = (part[:, :-1].astype(np.uint16) << 8) | part[:, 1:]
            pooled = []
            for w in WIDTHS:
                z = None
                for j, look in self.lookup[w]:
                    ids = (two if len(look) > 256 else part)[:, j : j + WINDOW - w + 1]
                    z = look[ids] if z is None else z + look[ids]
                pooled.append(z.max(axis=1) + self.p[f"b{w}"])
            s = np.maximum(np.hstack(pooled), 0) @ self.p["o"] + self.p["c"]
            s = np.exp(s - s.max(axis=1, keepdims=True))
            out.append(s / s.sum(axis=1, keepdims=True))
        return np.concatenate(out)


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], ByteNet | None]:
    """Languages and a network trained on a bounded sample of windows of the rows that aren't held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("doc_id is not null and lang is not null and octet_length(text) > 0").where(~held_out(F.col("doc_id")))
    windows_of = F.greatest(F.ceil((F.octet_length("text") - WINDOW) / STRIDE), F.lit(0)) + 1
    counts = written(rows.groupBy("lang").agg(F.sum(windows_of).alias("n")), "languages")
    wanted = max(1, min(LANGUAGE, SAMPLE // max(1, counts.count())))
    # languages beyond the bound (there is a window at least of each) can't be learned: the most frequent ones are
    counts = F.broadcast(counts.orderBy(F.desc("n"), "lang").limit(SAMPLE))
    # a share of each language's windows by hash that leaves about twice as many as wanted, so that no task ranks all of a language
    at = F.explode(F.sequence(F.lit(0).cast("long"), windows_of.cast("long") - 1)).alias("k")
    places = rows.select("doc_id", "lang", "text", at).withColumn("h", F.xxhash64("doc_id", "k", F.lit(SEED)))
    places = places.join(counts, "lang").where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) * F.col("n") < 2 * wanted)
    cut = F.substring(F.encode("text", "UTF-8"), (F.col("k") * STRIDE + 1).cast("int"), F.lit(WINDOW)).alias("w")
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "k", "w")
    chosen = places.select("doc_id", "lang", "k", "h", cut).withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)
    # at most SAMPLE windows
    rows = sorted((r["lang"], bytes(r["w"]).lower().ljust(WINDOW, b"\0")) for r in chosen.select("lang", "w").collect())
    langs = sorted({r[0] for r in rows})
    if not langs:
        return [], None
    x = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
    number = {lang: k for k, lang in enumerate(langs)}
    net = ByteNet(len(langs)).train(x, np.array([number[r[0]] for r in rows]))
    net.tables()
    return langs, net


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; score is the mean probability of the predicted language.

    Learns from text and non-null language of rows whose crc32 of the id as text isn't divisible by 5. Texts that are null or
    without a letter are `und` with score 0, as is everything if nothing can be learned from; texts of any length are read to their end. Repeated and null ids give a row each (null: not
    held out, not learned from). Columns not named are ignored. No rows: no rows.
    """
    langs, net = fit(docs, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            pred, score = [], []
            for text in b.column(2).to_pylist():
                if net is None or not any(map(str.isalpha, text or "")):
                    pred.append("und")
                    score.append(0.0)
                    continue
                x, sizes = windows(text)
                p = np.average(net.predict(x), axis=0, weights=sizes)
                pred.append(langs[int(p.argmax())])
                score.append(float(min(1.0, p.max())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
