"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time. It reads a text's UTF-8 bytes in
windows of `WINDOW`, forwards and backwards, labels every byte with a distribution over the languages, and
a document's distribution is the mean over all its bytes: whole texts, no prefixes. Gates are piecewise
linear (clip(0.2 x + 0.5, 0, 1)), candidates tanh.

Training takes windows of at most `quota` documents a language, chosen by a hash of their ids among the
labelled documents outside the held-out fold (crc32 of the id as text, modulo 5, is 0); that bound is a
parameter, prediction covers every row. The language column is read for training only.

Rules: `und` with score 0 where the text is null or has no letter, or nothing could be learned; a document
without language or id is never learned from; repeated rows get a row each; ties go to the language first
in order; a null id counts as not held out; other columns are ignored; empty in, empty out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

WINDOW, HIDDEN, QUOTA, STEPS, BATCH = 64, 8, 400, 120, 256
_LETTER = re.compile(r"[^\W\d_]").search


class Direction:
    """One direction's weights. Rows of e and u: update gate, reset gate, candidate."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        self.e = (0.3 * rng.standard_normal((3 * hidden, 256))).astype(np.float32)
        self.u = (rng.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)

    def learn_forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States (T, h, B) for bytes (T, B), and what the way back needs."""
        n, kept = self.h, []
        h = np.zeros((n, x.shape[1]), np.float32)
        out = np.empty((len(x), n, x.shape[1]), np.float32)
        for t, now in enumerate(x):
            a, u = self.e[:, now], self.u @ h
            raw = 0.2 * (a[: 2 * n] + u[: 2 * n]) + 0.5
            g = np.clip(raw, 0, 1)
            c = np.tanh(a[2 * n :] + g[n:] * u[2 * n :])
            kept.append((now, h, g, (raw > 0) & (raw < 1), u[2 * n :], c))
            h = c + g[:n] * (h - c)
            out[t] = h
        return out, kept

    def learn_back(self, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of e and u for gradients (T, h, B) of the states."""
        n = self.h
        de, du = np.zeros((256, 3 * n), np.float32), np.zeros_like(self.u)
        dh = np.zeros_like(d_out[0])
        for t in range(len(kept) - 1, -1, -1):
            now, h, g, open_, uc, c = kept[t]
            dh = dh + d_out[t]
            dc = dh * (1 - g[:n]) * (1 - c * c)
            dg = 0.2 * open_ * np.concatenate([dh * (h - c), dc * uc])
            da = np.concatenate([dg, dc])
            dr = np.concatenate([dg, dc * g[n:]])
            np.add.at(de, now, da.T)
            du += dr @ h.T
            dh = dh * g[:n] + self.u.T @ dr
        return [de.T, du]

    def prepared(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights with the gates' slope and offset folded in."""
        e, u, n = self.e.copy(), self.u.copy(), 2 * self.h
        e[:n] = 0.2 * e[:n] + 0.5
        u[:n] *= 0.2
        return np.ascontiguousarray(e.T), u


def states(e: np.ndarray, u: np.ndarray, x: np.ndarray) -> np.ndarray:
    n, (steps, width) = u.shape[1], x.shape
    h = np.zeros((n, width), np.float32)
    out = np.empty((steps, n, width), np.float32)
    for t in range(steps):
        a = np.ascontiguousarray(e[x[t]].T)
        r = u @ h
        g = a[: 2 * n]
        g += r[: 2 * n]
        np.clip(g, 0, 1, out=g)
        c = r[2 * n :]
        c *= g[n:]
        c += a[2 * n :]
        np.tanh(c, out=c)
        h = h - c
        h *= g[:n]
        h += c
        out[t] = h
    return out


class Network:
    def __init__(self, langs: list[str], seed: int = 1, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.ahead, self.behind = Direction(rng, hidden), Direction(rng, hidden)
        self.w = (0.1 * rng.standard_normal((len(langs), 2 * hidden))).astype(np.float32)
        self.b = np.zeros((len(langs), 1), np.float32)

    def loss(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy a byte of windows (T, B) with languages y (B,), and the gradients of ahead, behind, w and b."""
        f, kept_f = self.ahead.learn_forward(x)
        r, kept_r = self.behind.learn_forward(x[::-1])
        both = np.concatenate([f, r[::-1]], axis=1)
        z = self.w @ both + self.b
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        cols, total = np.arange(len(y)), mask.sum()
        value = -(np.log(np.maximum(p[:, y, cols], 1e-12)) * mask).sum() / total
        p[:, y, cols] -= 1
        p *= (mask / total)[:, None, :].astype(np.float32)
        d_both = self.w.T @ p
        n = self.ahead.h
        grads = self.ahead.learn_back(kept_f, d_both[:, :n]) + self.behind.learn_back(kept_r, d_both[::-1, n:])
        return float(value), grads + [np.einsum("tkb,thb->kh", p, both), p.sum((0, 2))[:, None]]

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.ahead.e, self.ahead.u, self.behind.e, self.behind.u, self.w, self.b]

    def fit(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 2) -> float:
        """Adam on random batches of the windows (N, T). Returns the last losses' mean."""
        rng, last = np.random.default_rng(seed), []
        m, v = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), min(batch, 4 * len(x)))
            value, grads = self.loss(np.ascontiguousarray(x[at].T), mask[at].T, y[at])
            rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for w, g, a, b in zip(self.weights, grads, m, v):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            last = [*last[-19:], value]
        return float(np.mean(last))

    def pooled(self, texts: list[bytes], group: int = 2048) -> np.ndarray:
        """(N, languages): the mean over a text's bytes of their distributions; zero for an empty text."""
        size = np.array([len(t) for t in texts], np.int64)
        many = -(-size // WINDOW)
        x = np.zeros(int(many.sum()) * WINDOW, np.uint8)
        at = np.concatenate([[0], np.cumsum(many)])
        for k, t in enumerate(texts):
            x[at[k] * WINDOW : at[k] * WINDOW + size[k]] = np.frombuffer(t, np.uint8)
        x = x.reshape(-1, WINDOW)
        filled = np.full(len(x), WINDOW)
        full = many > 0
        filled[at[1:][full] - 1] = size[full] - (many[full] - 1) * WINDOW
        sums = np.empty((len(x), len(self.langs)), np.float32)
        fe, fu = self.ahead.prepared()
        be, bu = self.behind.prepared()
        n = self.ahead.h
        for a in range(0, len(x), group):
            part = np.ascontiguousarray(x[a : a + group].T)
            f, r = states(fe, fu, part), states(be, bu, part[::-1])
            total = np.zeros((len(self.langs), part.shape[1]), np.float32)
            live = filled[a : a + group]
            for t in range(WINDOW):
                z = self.w[:, :n] @ f[t]
                z += self.w[:, n:] @ r[WINDOW - 1 - t]
                z += self.b
                np.minimum(z, 60, out=z)
                np.exp(z, out=z)
                z *= (t < live) / z.sum(0)
                total += z
            sums[a : a + group] = total.T
        out = np.zeros((len(texts), len(self.langs)))
        for k in np.flatnonzero(full):
            out[k] = sums[at[k] : at[k + 1]].sum(0, dtype=np.float64) / size[k]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        ok = [bool(self.langs and t and _LETTER(t)) for t in texts]
        p = self.pooled([t.encode() if k else b"" for t, k in zip(texts, ok)])
        best = p.argmax(1) if self.langs else np.zeros(len(texts), int)
        return [self.langs[b] if k else "und" for b, k in zip(best, ok)], [min(1.0, float(p[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best, ok))]


def windows(rows: list[tuple[str, str]], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training windows (N, T), which bytes count, and language numbers of (text, language) rows."""
    x, mask, y = [], [], []
    for text, lang in rows:
        raw = text.encode()
        for a in range(0, len(raw), WINDOW):
            part = np.frombuffer(raw[a : a + WINDOW], np.uint8)
            x.append(np.pad(part, (0, WINDOW - part.size)))
            mask.append(np.arange(WINDOW) < part.size)
            y.append(langs.index(lang))
    return np.array(x), np.array(mask), np.array(y)


def held_out(id_col: str, fold: int, left: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % fold == left, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quota: int = QUOTA, chars: int = 4 * WINDOW) -> Network:
    """The network learned from about `quota` documents a language, a stretch of `chars` characters of each, from anywhere in the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("doc_id is not null and lang is not null and length(text) > 0").where(~held_out("doc_id", 5, 0))
    # the languages, which are few, and how many documents they have
    share = {r.lang: min(1.0, quota / r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(share)
    if not langs:
        return Network([])
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.element_at(F.create_map(*[F.lit(v) for kv in share.items() for v in kv]), F.col("lang"))
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    sample = rows.where(lot < wanted).select("doc_id", "lang", F.substring("text", start.cast("int"), F.lit(chars)).alias("text"))
    got = sorted((r.doc_id, r.text, r.lang) for r in sample.limit(4 * quota * len(langs)).collect())
    if not got:
        return Network([])
    langs = sorted({lang for _, _, lang in got})
    net = Network(langs)
    x, mask, y = windows([(t, lang) for _, t, lang in got], langs)
    share_of = np.bincount(y)  # languages weigh alike
    pick = np.random.default_rng(3).choice(len(y), size=4 * max(len(y) // len(langs), 1) * len(langs), p=(1 / share_of[y]) / (1 / share_of[y]).sum())
    net.fit(x[pick], mask[pick], y[pick])
    return net


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score = net.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, net: Network, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, whose language is recognized with a score of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            lang, score = net.predict(b.column(text_col).to_pylist())
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
