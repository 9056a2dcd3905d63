r"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is read in windows of `width` bytes, all of them; in each window a forward and a backward network of gated units run over the
bytes, every position gets probabilities of the languages, and a text's probabilities are the mean over its positions. train()
learns by backpropagation through time on the driver, from a sample with documented bounds: `docs_each` texts of each language,
`windows_each` windows of each text at seeded places. Prediction takes windows from many texts in step, so that a step is a few
array operations; it holds `chunk` bytes at a time, however long a text is.

Letters are what Unicode calls so (`\p{L}`): digits, fractions, numerals and marks of any script aren't.

Defined results: a text that is null or has no letter is `und` with score 0, as is every text if there is nothing to learn from;
a null doc_id is not held out and not learned from; repeated rows get a row each and are learned from once; ties go to the first language by name; an empty table
gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tesserae.llm.common import join_hot, ready, text_of

PAD = 256


@dataclass
class Network:
    """x: input weights by byte (and PAD), u: recurrent ones, for update, reset and candidate; one pair each way; w, b: output."""

    langs: list[str]
    width: int
    x: list[np.ndarray]  # two of (257, 3 h)
    u: list[np.ndarray]  # two of (h, 3 h)
    w: np.ndarray  # (2 h, languages)
    b: np.ndarray

    @staticmethod
    def new(langs: list[str], hidden: int, width: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        x = [rng.normal(0, 0.3, (PAD + 1, 3 * hidden)).astype(np.float32) for _ in range(2)]
        u = [rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32) for _ in range(2)]
        for k in x:
            k[:, :hidden] += 1.0  # keep the state at first
        return Network(langs, width, x, u, rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))

    @property
    def hidden(self) -> int:
        return self.u[0].shape[0]

    def states(self, codes: np.ndarray, way: int) -> list[np.ndarray]:
        """The state at each position of codes (positions, windows); way 1 runs backward. PAD keeps the state as it is."""
        n, h = self.hidden, np.zeros((codes.shape[1], self.hidden), np.float32)
        x = self.x[way].copy()
        # sigmoid(v) = (1 + tanh(v / 2)) / 2
        x[:, : 2 * n] *= 0.5
        u = self.u[way].copy()
        u[:, : 2 * n] *= 0.5
        x[PAD] = 0
        x[PAD, :n] = 40
        out: list[np.ndarray] = [h] * len(codes)
        for t in range(len(codes)) if way == 0 else range(len(codes) - 1, -1, -1):
            a = np.take(x, codes[t], axis=0)
            g = h @ u
            gates = a[:, : 2 * n]
            gates += g[:, : 2 * n]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new = g[:, 2 * n :]
            new *= gates[:, n:]
            new += a[:, 2 * n :]
            np.tanh(new, out=new)
            h = h - new
            h *= gates[:, :n]
            h += new
            out[t] = h
        return out

    def probabilities(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """(windows, languages) for each position."""
        ahead, back = self.states(codes, 0), self.states(codes, 1)
        n = self.hidden
        for f, r in zip(ahead, back, strict=True):
            p = f @ self.w[:n]
            p += r @ self.w[n:]
            p += self.b
            np.exp(p, out=p)
            p /= p.sum(axis=1, keepdims=True)
            yield p

    def label(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of runs of bytes with one label."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        out: list[tuple[int, int, str]] = []
        for at in range(0, len(raw), self.width):
            for k, p in enumerate(self.probabilities(raw[at : at + self.width, None])):
                lang = self.langs[int(p[0].argmax())]
                if out and out[-1][2] == lang:
                    out[-1] = (out[-1][0], at + k + 1, lang)
                else:
                    out.append((at + k, at + k + 1, lang))
        return out

    def pooled(self, texts: list[bytes], chunk: int = 2 << 20) -> np.ndarray:
        """(texts, languages): mean probabilities over each text's positions; zeros for an empty text."""
        total = np.zeros((len(texts), len(self.langs)))
        held, size = [], 0

        def flush() -> None:
            sizes = np.array([len(p) for _, p in held])
            raw = np.frombuffer(b"".join(p for _, p in held), np.uint8)
            windows = -(-sizes // self.width)
            first = np.cumsum(windows) - windows
            codes = np.full(int(windows.sum()) * self.width, PAD, np.uint16)
            codes[np.arange(len(raw)) + np.repeat(first * self.width - (np.cumsum(sizes) - sizes), sizes)] = raw
            codes = codes.reshape(-1, self.width)
            owner = np.repeat([k for k, _ in held], windows)
            for at in range(0, len(codes), 4096):
                part = np.ascontiguousarray(codes[at : at + 4096].T)
                real = part != PAD
                sums = np.zeros((part.shape[1], len(self.langs)), np.float32)
                for p, ok in zip(self.probabilities(part), real, strict=True):
                    if not ok.all():
                        p *= ok[:, None]
                    sums += p
                for c in range(len(self.langs)):
                    total[:, c] += np.bincount(owner[at : at + 4096], sums[:, c], len(texts))

        for k, text in enumerate(texts):
            for at in range(0, len(text), chunk):  # chunk is a multiple of the width
                piece = text[at : at + chunk]
                held.append((k, piece))
                size += len(piece)
                if size >= chunk:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        lengths = np.array([max(1, len(t)) for t in texts])
        return total / lengths[:, None]


def _backward(net: Network, codes: np.ndarray, way: int, states: list[np.ndarray], d_states: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u of one way, through time."""
    n, (steps, batch) = net.hidden, codes.shape
    dx, du, dh = np.zeros_like(net.x[way]), np.zeros_like(net.u[way]), np.zeros((batch, n), np.float32)
    order = range(steps - 1, -1, -1) if way == 0 else range(steps)
    for t in order:
        before = t - 1 if way == 0 else t + 1
        h0 = states[before] if 0 <= before < steps else np.zeros((batch, n), np.float32)
        a, g = net.x[way][codes[t]], h0 @ net.u[way]
        z, r = 1 / (1 + np.exp(-(a[:, :n] + g[:, :n]))), 1 / (1 + np.exp(-(a[:, n : 2 * n] + g[:, n : 2 * n])))
        new = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
        dh = dh + d_states[t]
        d_new = dh * (1 - z) * (1 - new * new)
        d_z = dh * (h0 - new) * z * (1 - z)
        d_r = d_new * g[:, 2 * n :] * r * (1 - r)
        d_a = np.concatenate([d_z, d_r, d_new], axis=1)
        d_g = np.concatenate([d_z, d_r, d_new * r], axis=1)
        np.add.at(dx, codes[t], d_a)
        du += h0.T @ d_g
        dh = dh * z + d_g @ net.u[way].T
    return dx, du


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = 8, steps: int = 360, batch: int = 192, rate: float = 0.02, seed: int = 9) -> Network:
    """Fit a network to windows (rows of byte codes without PAD) whose positions all have the window's language."""
    net = Network.new(langs, hidden, windows.shape[1], seed)
    rng = np.random.default_rng(seed)
    weights = [*net.x, *net.u, net.w, net.b]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in weights]
    each = [np.flatnonzero(labels == k) for k in range(len(langs))]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(e, max(1, batch // len(langs))) for e in each])
        codes, y = np.ascontiguousarray(windows[pick].T), labels[pick]
        states = [net.states(codes, 0), net.states(codes, 1)]
        d_states = [[], []]
        dw, db = np.zeros_like(net.w), np.zeros_like(net.b)
        for f, r in zip(*states, strict=True):
            both = np.concatenate([f, r], axis=1)
            p = np.exp(both @ net.w + net.b)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= p.shape[0] * len(codes)
            dw += both.T @ p
            db += p.sum(axis=0)
            d = p @ net.w.T
            d_states[0].append(d[:, :hidden])
            d_states[1].append(d[:, hidden:])
        grads = [_backward(net, codes, way, states[way], d_states[way]) for way in (0, 1)]
        now = rate * 0.5 * (1 + np.cos(np.pi * step / steps)) + 1e-4
        for p, g, (m, v) in zip(weights, [grads[0][0], grads[1][0], grads[0][1], grads[1][1], dw, db], moments, strict=True):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def lettered(text: str = "text") -> Column:
    return text_of(text).rlike(r"\p{L}")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, docs_each: int = 300, windows_each: int = 16, width: int = 64, **how) -> Network | None:
    """A network from the texts that aren't held out; None if there are none with a language and letters."""
    able = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & lettered()).select("doc_id", "lang", text_of().alias("text"), F.xxhash64("text").alias("_t"))
    drawn = able.select("doc_id", "lang", "_t", F.xxhash64(F.lit(9), "doc_id").alias("_h"))
    # of each language the texts with the least hashes, some four times as many as are wanted; then the first of these
    many = drawn.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_n"))
    least = join_hot(drawn, many, ["lang"], "inner", salt_by=["_h"]).where(F.col("_h").cast("double") / 2.0**64 + 0.5 <= 4.0 * docs_each / F.col("_n"))
    rank = F.rank().over(Window.partitionBy("lang").orderBy("_h", "doc_id", "_t"))
    chosen = least.select("doc_id", "lang", "_t", "_h").distinct().withColumn("_k", rank).where(F.col("_k") <= docs_each).select("doc_id", "lang", "_t")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, parts, ids = [], [], []
            for doc_id, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_py()
                rng = np.random.default_rng(doc_id % (1 << 32))
                places = rng.integers(0, max(1, len(text) - width + 1), windows_each) if len(text) > width else [0]
                for k in places:
                    piece = text[k : k + width]
                    langs.append(lang)
                    ids.append(doc_id)
                    parts.append((piece * (width // max(1, len(piece)) + 1))[:width])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["doc_id", "lang", "part"])

    ready(docs.sparkSession)
    # docs_each texts of each language, so this side is small
    texts = able.join(F.broadcast(chosen), ["doc_id", "lang", "_t"]).dropDuplicates(["doc_id", "lang", "_t"])
    rows = texts.select("doc_id", "lang", F.col("text").cast("binary").alias("text")).mapInArrow(cut, "doc_id long, lang string, part binary").toPandas().sort_values(["lang", "doc_id", "part"], kind="stable")
    if not len(rows):
        return None
    langs = sorted(rows["lang"].unique())
    codes = np.stack([np.frombuffer(bytes(p), np.uint8) for p in rows["part"]]).astype(np.uint16)
    return train(codes, rows["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(), langs, **how)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the pooled probability) of each row."""
    names = ["doc_id", "held_out", "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(2)]
            able = np.array(b.column(3).to_pylist(), bool) & (net is not None)
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            if able.any():
                at = np.flatnonzero(able)
                p = net.pooled([texts[k] for k in at])
                for k, best, score in zip(at.tolist(), p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    langs[k], scores[k] = net.langs[best], min(1.0, float(score))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), text_of().cast("binary").alias("text"), lettered().alias("able")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def report(docs: DataFrame, **how) -> DataFrame:
    return predict(docs, learn(docs, **how))
