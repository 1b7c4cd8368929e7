"""Operator 4: language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers of gated units read the bytes forwards and backwards; every position gets probabilities of all
languages, and a document's are the mean over its positions. The network is trained in numpy by backpropagation through
time on the driver, on a bounded sample of short stretches. For scoring, whole texts are cut into windows of `WINDOW`
bytes and thousands of windows advance together, one byte a step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import lean, small_batches, text_pieces

HIDDEN, WINDOW = 8, 64

#: Stretches the network is trained on, at most: so many for each language, and in all.
MAX_PER_LANGUAGE, MAX_STRETCHES = 900, 30_000

#: Stretches from one text, at most.
MAX_PER_TEXT = 32

#: Characters of a training stretch.
STRETCH = 64


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteNetwork:
    """Weights: for each direction a table of bytes (E), a recurrent matrix (U) and its bias (b); then V and c for the output."""

    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        h, n = HIDDEN, len(languages)
        self.languages = languages
        self.w = {f"E{d}": rng.normal(0, 0.3, (256, 3 * h)) for d in "fb"} | {f"U{d}": rng.normal(0, h**-0.5, (h, 3 * h)) for d in "fb"}
        self.w |= {f"b{d}": np.zeros(h) for d in "fb"} | {"V": rng.normal(0, (2 * h) ** -0.5, (2 * h, n)), "c": np.zeros(n)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    # -- training --

    def _forward(self, d: str, x: np.ndarray) -> dict[str, np.ndarray]:
        """All states of one direction over x, bytes by (step, stretch)."""
        h = HIDDEN
        e, u, b = self.w[f"E{d}"], self.w[f"U{d}"], self.w[f"b{d}"]
        steps, n = x.shape
        s = {k: np.zeros((steps, n, h), np.float32) for k in ("before", "z", "r", "n", "m", "h")}
        now = np.zeros((n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, g = e[x[t]], now @ u
            zr = _sigmoid(a[:, : 2 * h] + g[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            m = g[:, 2 * h :] + b
            new = np.tanh(a[:, 2 * h :] + r * m)
            s["before"][t], s["z"][t], s["r"][t], s["n"][t], s["m"][t] = now, z, r, new, m
            now = (1 - z) * new + z * now
            s["h"][t] = now
        return s

    def _backward(self, d: str, x: np.ndarray, s: dict[str, np.ndarray], out: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of one direction, from the gradients `out` of its states."""
        h = HIDDEN
        u = self.w[f"U{d}"]
        steps, n = x.shape
        da = np.zeros((steps, n, 3 * h), np.float32)
        du, db, carried = np.zeros_like(u), np.zeros(h, np.float32), np.zeros((n, h), np.float32)
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            dh = out[t] + carried
            before, z, r, new, m = (s[k][t] for k in ("before", "z", "r", "n", "m"))
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (before - new) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            dm = dn * r
            da[t] = np.concatenate([dz, dr, dn], 1)
            dg = np.concatenate([dz, dr, dm], 1)
            du += before.T @ dg
            db += dm.sum(0)
            carried = dh * z + dg @ u.T
        hot = np.zeros((x.size, 256), np.float32)
        hot[np.arange(x.size), x.ravel()] = 1
        return {f"E{d}": hot.T @ da.reshape(-1, 3 * h), f"U{d}": du, f"b{d}": db}

    def fit(self, x: np.ndarray, valid: np.ndarray, y: np.ndarray, least_steps: int = 160, batch: int = 128, rate: float = 0.02, seed: int = 5) -> None:
        """Minimise the cross-entropy at every position with Adam. x, valid: (stretch, step); y: language of each stretch."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        epochs = max(6, -(-least_steps // max(1, -(-len(x) // batch))))
        step, total = 0, max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for low in range(0, len(x), batch):
                rows = order[low : low + batch]
                bytes_, on, truth = x[rows].T, valid[rows].T, y[rows]
                f, b = self._forward("f", bytes_), self._forward("b", bytes_)
                states = np.concatenate([f["h"], b["h"]], 2)
                p = self._probabilities(states)
                p[:, np.arange(len(rows)), truth] -= 1
                p *= (on / max(on.sum(), 1))[:, :, None].astype(np.float32)
                flat = p.reshape(-1, p.shape[2])
                slope = {"V": states.reshape(-1, 2 * HIDDEN).T @ flat, "c": flat.sum(0)}
                out = p @ self.w["V"].T
                slope |= self._backward("f", bytes_, f, out[:, :, :HIDDEN]) | self._backward("b", bytes_, b, out[:, :, HIDDEN:])
                norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in slope.values())))
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for k, g in slope.items():
                    g = g * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
                    first[k] += np.float32(0.1) * (g - first[k])
                    second[k] += np.float32(0.01) * (g * g - second[k])
                    self.w[k] -= np.float32(now) * (first[k] / np.float32(1 - 0.9**step)) / (np.sqrt(second[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))

    def _probabilities(self, states: np.ndarray) -> np.ndarray:
        scores = states @ self.w["V"] + self.w["c"]
        scores -= scores.max(-1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(-1, keepdims=True)
        return scores

    # -- scoring --

    def _states(self, d: str, x: np.ndarray, out: np.ndarray) -> None:
        """States of one direction over x (step, window) into out (step, window, HIDDEN), with buffers reused."""
        h = HIDDEN
        half = np.r_[np.full(2 * h, 0.5), np.ones(h)].astype(np.float32)  # tanh of half the sum makes a sigmoid
        e, u = self.w[f"E{d}"] * half, self.w[f"U{d}"] * half
        bias = np.r_[np.zeros(2 * h), self.w[f"b{d}"]].astype(np.float32)
        n = x.shape[1]
        a, g, now = np.empty((n, 3 * h), np.float32), np.empty((n, 3 * h), np.float32), np.zeros((n, h), np.float32)
        gates, new = np.empty((n, 2 * h), np.float32), np.empty((n, h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.take(e, x[t], axis=0, out=a, mode="clip")
            np.matmul(now, u, out=g)
            g += bias
            np.add(a[:, : 2 * h], g[:, : 2 * h], out=gates)
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            np.multiply(gates[:, h:], g[:, 2 * h :], out=new)
            new += a[:, 2 * h :]
            np.tanh(new, out=new)
            now -= new
            now *= gates[:, :h]
            now += new
            out[t] = now

    def pooled(self, column: pa.Array) -> np.ndarray:
        """Mean probabilities of each text over all its bytes; zeros for null and empty texts."""
        rows = []
        for _, _, data, offsets in text_pieces(column):
            sizes = np.diff(offsets)
            n_windows = -(-sizes // WINDOW)
            owner = np.repeat(np.arange(len(sizes)), n_windows)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
            starts = offsets[owner] + within * WINDOW
            lengths = np.minimum(WINDOW, offsets[owner + 1] - starts)
            total = np.zeros((len(sizes), len(self.languages)))
            for low in range(0, len(owner), 4096):
                part = slice(low, low + 4096)
                on = np.arange(WINDOW)[:, None] < lengths[part]
                x = np.where(on, data[np.minimum(starts[part] + np.arange(WINDOW)[:, None], len(data) - 1)], 0)
                states = np.empty((WINDOW, x.shape[1], 2 * HIDDEN), np.float32)
                for k, d in enumerate("fb"):
                    self._states(d, x, states[:, :, k * HIDDEN : (k + 1) * HIDDEN])
                sums = (self._probabilities(states) * on[:, :, None]).sum(0)
                np.add.at(total, owner[part], sums)
            rows.append(total / np.maximum(sizes, 1)[:, None])
        return np.concatenate(rows) if rows else np.zeros((0, len(self.languages)))


def learning_row(doc_id: Column) -> Column:
    """Whether a document may be learned from: CRC-32 of its id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def fit_language(docs: DataFrame) -> ByteNetwork:
    """Train on at most MAX_PER_LANGUAGE stretches of a language, from anywhere in the texts that may be learned from."""
    rows = docs.where(learning_row(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("text") != ""))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    languages = sorted(counts)
    each = max(1, min(MAX_PER_LANGUAGE, MAX_STRETCHES // max(len(languages), 1)))
    if not languages:
        return ByteNetwork([])
    chance, several = F.lit(0.0), F.lit(1)
    for lang in languages:  # a few more than needed, by hash, so that only they are sorted; from few texts several stretches each
        n = min(MAX_PER_TEXT, -(-each // counts[lang]))
        several = F.when(F.col("lang") == lang, n).otherwise(several)
        chance = F.when(F.col("lang") == lang, min(1.0, (each + 6 * each**0.5) / (counts[lang] * n))).otherwise(chance)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    spot = 1 + F.pmod(F.xxhash64("doc_id", "nth"), F.greatest(F.length("text") - STRETCH, F.lit(0)) + 1)
    cut = F.when(F.length("text") <= STRETCH, F.col("text")).otherwise(F.substring("text", spot.cast("int"), F.lit(STRETCH)))
    chosen = rows.where(drawn < chance).select("doc_id", "lang", "text", F.explode(F.sequence(F.lit(1), several)).alias("nth"))
    cuts = chosen.select("lang", F.xxhash64("doc_id", "nth").alias("order"), cut.alias("cut"))
    found = cuts.groupBy("lang", "order").agg(F.min("cut").alias("cut")).toPandas().sort_values(["lang", "order", "cut"])  # an id counts once, however many rows have it
    found = found.groupby("lang").head(each)
    raw = [t.encode()[:WINDOW] for t in found["cut"]]
    x = np.zeros((len(raw), WINDOW), np.uint8)
    for row, text in zip(x, raw, strict=True):
        row[: len(text)] = np.frombuffer(text, np.uint8)
    valid = np.arange(WINDOW) < np.array([len(t) for t in raw])[:, None]
    network = ByteNetwork(languages)
    network.fit(x, valid, np.searchsorted(languages, found["lang"].to_numpy(str)))
    return network


def language_of(text: Column, network: ByteNetwork) -> Column:
    """struct(lang, score) of a text column; scores are the pooled probability of the language named.

    Null and empty texts get the first language and score 0; without a language to name, lang is null. Whole texts are read,
    in windows, so a very long one takes no more memory at once than others.
    """

    @F.arrow_udf("struct<lang: string, score: double>")
    def run(column: pa.Array) -> pa.Array:
        lean()
        p = network.pooled(column)
        best = p.argmax(1) if p.shape[1] else np.zeros(len(p), int)
        names = [network.languages[i] for i in best] if p.shape[1] else [None] * len(p)
        score = p[np.arange(len(p)), best] if p.shape[1] else np.zeros(len(p))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.clip(score.astype(float), 0, 1))], ["lang", "score"])

    return run(text)


def predict_language(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score.

    Texts null, empty or without a letter are `und` with score 0; so is every text if nothing can be learned from.
    Only a text's bytes are read for its prediction. Repeated rows are each answered; rows without an id are neither
    learned from nor held out; other columns are not read.
    """
    network = fit_language(docs)
    told = small_batches(docs).select("doc_id", F.coalesce(~learning_row(F.col("doc_id")) & F.col("doc_id").isNotNull(), F.lit(False)).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), language_of(F.col("text"), network).alias("said"))
    named = F.col("letters") & F.col("said.lang").isNotNull()
    return told.select("doc_id", "held_out", F.when(named, F.col("said.lang")).otherwise("und").alias("lang_pred"), F.when(named, F.col("said.score")).otherwise(0.0).alias("score"))
