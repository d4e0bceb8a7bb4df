"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import mix, slices
from cinelake.llm.words import PRETOKEN, Pretokens, span_hashes

WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND, CHAR_ROWS = 8, 8, 8, 8, 2048


def _cut(text: str) -> list[str]:
    return regex.findall(PRETOKEN, unicodedata.normalize("NFC", text).lower())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _scatter(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the values of each row number."""
    out = np.zeros((size, values.shape[1]), np.float32)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        at = np.flatnonzero(np.diff(rows[order], prepend=-1))
        out[rows[order][at]] = np.add.reduceat(values[order], at, axis=0)
    return out


@dataclass
class Tokens:
    """Distinct tokens of a batch (hash, character grams) and the tokens of each text as rows among them."""

    hashes: np.ndarray
    grams: np.ndarray
    gram_starts: np.ndarray
    rows: np.ndarray
    bounds: np.ndarray


def tokens_of(texts: list[str]) -> Tokens:
    """Lower-cased runs of letters, digits one by one, and runs of other signs; with the hashed 3-grams of their bytes."""
    p = Pretokens(texts, _cut, special=False)
    keys = span_hashes(p.data, p.starts, p.ends) if len(p.data) else np.zeros(len(p.starts), np.uint64)
    hashes, at, rows = np.unique(keys, return_index=True, return_inverse=True)
    start, size = p.starts[at], p.ends[at] - p.starts[at]
    begin = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(size)), size)
    place = np.repeat(start - begin[:-1], size) + np.arange(begin[-1])
    inner = np.arange(begin[-1]) - begin[owner]
    code = p.data[place].astype(np.uint64) if len(place) else np.zeros(0, np.uint64)
    before, after = np.full(len(code), 256, np.uint64), np.full(len(code), 257, np.uint64)
    if len(code):
        before[1:] = np.where(inner[1:] > 0, code[:-1], 256)
        after[:-1] = np.where(inner[1:] > 0, code[1:], 257)
    grams = (mix((before << np.uint64(40)) | (code << np.uint64(20)) | after) % np.uint64(CHAR_ROWS)).astype(np.int64)
    bounds = np.searchsorted(p.owner, np.arange(len(texts) + 1))
    return Tokens(hashes, grams, begin, rows, bounds)


def windows_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start (among all tokens) and text of every window: each token but those at the rims is in two of them."""
    size = np.diff(bounds)
    count = np.where(size > 0, np.maximum(0, -(-(size - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(size)), count)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    return bounds[text] + STRIDE * (np.arange(len(text)) - first[text]), text


class Network:
    """Weights by name. Word rows: the last one stands for all unknown words."""

    def __init__(self, words: np.ndarray, odds: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        f = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else shape[0])).astype(np.float32)
        self.words = words
        word = 0.1 * r.standard_normal((len(words) + 1, WORD_DIM)).astype(np.float32)
        word[: len(words), 0] += odds.astype(np.float32)
        self.p = {
            "word": word, "char": 0.1 * r.standard_normal((CHAR_ROWS, CHAR_DIM)).astype(np.float32), "win": f(2, d, 3 * h), "bin": np.zeros((2, 3 * h), np.float32),
            "rec": f(2, h, 3 * h), "att": f(2 * h, ATTEND), "pick": f(ATTEND), "out": f(2 * h), "bias": np.zeros(1, np.float32),
        }
        self.scale, self.middle, self.prior = 1.0, 0.0, 0.0

    def word_rows(self, t: Tokens) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, t.hashes), max(len(self.words) - 1, 0))
        return np.where(self.words[at] == t.hashes, at, len(self.words)) if len(self.words) else np.zeros(len(t.hashes), np.int64)

    def inputs(self, t: Tokens, word: np.ndarray) -> np.ndarray:
        size = np.diff(t.gram_starts)
        chars = np.zeros((len(size), CHAR_DIM), np.float32)
        has = size > 0
        if has.any():
            chars[has] = np.add.reduceat(self.p["char"][t.grams], t.gram_starts[:-1][has], axis=0) / size[has, None]
        return np.concatenate([self.p["word"][word], chars], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Input parts of both directions' gates for each row, and a last row that leaves the state as it is."""
        g = x @ self.p["win"] + self.p["bin"][:, None]
        rest = np.zeros((2, 1, g.shape[2]), np.float32)
        rest[:, :, :HIDDEN] = 30
        return np.concatenate([g, rest], axis=1)

    def run(self, gates: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logit of each window. index: windows x WINDOW rows of gates (the last row pads)."""
        n, steps, h = len(index), index.shape[1], HIDDEN
        p, pad = self.p, index == gates.shape[1] - 1
        state = np.zeros((2, n, h), np.float32)
        states = np.empty((steps, 2, n, h), np.float32)
        kept = []
        for t in range(steps):
            own = np.stack([gates[0][index[:, t]], gates[1][index[:, steps - 1 - t]]])
            rec = state @ p["rec"]
            zr = _sigmoid(own[..., : 2 * h] + rec[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            new = np.tanh(own[..., 2 * h :] + r * rec[..., 2 * h :])
            if keep:
                kept.append((state, z, r, new, rec[..., 2 * h :]))
            state = new + z * (state - new)
            states[t] = state
        seq = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # steps, n, 2h
        hid = np.tanh(seq @ p["att"])
        score = np.where(pad.T, -1e9, hid @ p["pick"])
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, seq)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (kept, seq, hid, weight, pooled)) if keep else logit

    def gradients(self, x: np.ndarray, index: np.ndarray, memory, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weights that ``run`` uses and of the rows of x, by going back through time."""
        kept, seq, hid, weight, pooled = memory
        p, h, steps = self.p, HIDDEN, index.shape[1]
        g = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dpooled = dlogit[:, None] * p["out"]
        dseq = weight[..., None] * dpooled
        dweight = np.einsum("nh,tnh->tn", dpooled, seq)
        dscore = weight * (dweight - (weight * dweight).sum(axis=0))
        g["pick"] = np.einsum("tn,tna->a", dscore, hid)
        dpre = dscore[..., None] * p["pick"] * (1 - hid**2)
        g["att"] = np.einsum("tnh,tna->ha", seq, dpre)
        dseq = dseq + dpre @ p["att"].T
        downs = np.empty((2, steps, len(index), 3 * h), np.float32)
        g["rec"] = np.zeros_like(p["rec"])
        dstate = np.zeros((2, len(index), h), np.float32)
        for t in range(steps - 1, -1, -1):
            dstate = dstate + np.stack([dseq[t, :, :h], dseq[steps - 1 - t, :, h:]])
            state, z, r, new, recn = kept[t]
            dz = dstate * (state - new) * z * (1 - z)
            dnew = dstate * (1 - z) * (1 - new**2)
            dr = dnew * recn * r * (1 - r)
            drec = np.concatenate([dz, dr, dnew * r], axis=2)
            down = np.concatenate([dz, dr, dnew], axis=2)
            downs[0, t], downs[1, steps - 1 - t] = down[0], down[1]
            g["rec"] += np.swapaxes(state, 1, 2) @ drec
            dstate = dstate * z + drec @ np.swapaxes(p["rec"], 1, 2)
        rows = index.T.ravel()
        dgates = np.stack([_scatter(rows, d.reshape(len(rows), -1), len(x) + 1)[:-1] for d in downs])
        g["win"] = x.T @ dgates
        g["bin"] = dgates.sum(axis=1)
        return g, (dgates @ np.swapaxes(p["win"], 1, 2)).sum(axis=0)

    def index(self, t: Tokens, start: np.ndarray, text: np.ndarray) -> np.ndarray:
        at = start[:, None] + np.arange(WINDOW)
        inside = at < t.bounds[text + 1][:, None]
        return np.where(inside, t.rows[np.minimum(at, len(t.rows) - 1)], len(t.hashes)) if len(t.rows) else at

    def window_logits(self, t: Tokens, batch: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, text = windows_of(t.bounds)
        out = np.empty(len(start), np.float32)
        if len(start):
            gates = self.gates(self.inputs(t, self.word_rows(t)))
            for a in range(0, len(start), batch):
                out[a : a + batch] = self.run(gates, self.index(t, start[a : a + batch], text[a : a + batch]))
        return out, start, text

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text (that of its most toxic window; the prior without tokens), its windows, and the top one's start."""
        t = tokens_of(texts)
        logit, start, text = self.window_logits(t)
        count = np.bincount(text, minlength=len(texts))
        top, at = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
        if len(text):
            order = np.lexsort((start, -logit, text))
            head = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]
            top[text[head]], at[text[head]] = logit[head], start[head] - t.bounds[text[head]]
        if not self.scale:
            return np.full(len(texts), self.prior), count, at
        with np.errstate(over="ignore"):
            value = 1 / (1 + np.exp(-self.scale * (top.astype(np.float64) - self.middle)))
        return np.where(count > 0, value, self.prior), count, at


def train(texts: list[str], labels: list[int], steps: int = 200, pack: int = 32, seed: int = 7) -> Network:
    """Fits the network to texts with labels 0 and 1: a text is as toxic as its most toxic window.

    Words get a row if they are in four texts or more and in unequal shares of the two labels' texts (three standard
    errors); it starts from their smoothed log-odds. All other words are known by their characters only. Each step scores all windows of
    ``pack`` texts, and goes back through the two top ones of each; about ``steps`` steps, but 5 to 100 passes. A fifth of
    each label's texts, one at least where there are two, is kept apart to set the middle of the final logistic curve. Without both labels the network is its prior: the share of label 1 (0 of none).
    """
    y = np.array(labels, np.float32)
    net = Network(np.zeros(0, np.uint64), np.zeros(0))
    net.prior = float(y.mean()) if len(y) else 0.0
    if len(set(labels)) < 2:
        net.scale = 0.0
        return net
    r = np.random.default_rng(seed)
    order = np.concatenate([r.permutation(np.flatnonzero(y == k)) for k in (0, 1)])
    apart = np.concatenate([q[: -(-len(q) // 5) if len(q) > 1 else 0] for q in (order[y[order] == 0], order[y[order] == 1])])
    fit = np.setdiff1d(order, apart)
    seen: list[Counter] = [Counter(), Counter()]
    for a in range(0, len(fit), pack):
        some = fit[a : a + pack]
        t = tokens_of([texts[i] for i in some])
        for k, i in enumerate(some):
            seen[int(y[i])].update(np.unique(t.hashes[t.rows[t.bounds[k] : t.bounds[k + 1]]]).tolist())
    words = np.array(sorted(w for w in seen[0] | seen[1] if seen[0][w] + seen[1][w] >= 4), np.uint64)
    n0, n1 = (y[fit] == 0).sum(), (y[fit] == 1).sum()
    with0, with1 = (np.array([seen[k][w] for w in words.tolist()], np.float64) for k in (0, 1))
    both = (with0 + with1) / (n0 + n1)
    z = (with1 / n1 - with0 / n0) / np.sqrt(both * (1 - both) * (1 / n0 + 1 / n1) + 1e-12)
    odds = np.log((with1 + 1) / (n1 + 2)) - np.log((with0 + 1) / (n0 + 2))
    telling = np.abs(z) >= 3
    words, odds = words[telling], odds[telling]
    net = Network(words, np.clip(odds, -2, 4) / 2, seed)
    net.prior = float(y.mean())
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, epochs = 0, min(100, max(5, steps * pack // len(fit)))
    for epoch in range(epochs):
        mixed = r.permutation(fit)
        for a in range(0, len(mixed), pack):
            some = mixed[a : a + pack]
            t = tokens_of([texts[i] for i in some])
            logit, start, text = net.window_logits(t)
            if len(text) == 0:
                continue
            by = np.lexsort((-logit, text))
            rank = np.arange(len(by)) - np.searchsorted(text[by], text[by])
            top = by[rank < 2]
            word = net.word_rows(t)
            word = np.where(r.random(len(word)) < 0.1, len(net.words), word)  # so that characters count, too
            x = net.inputs(t, word)
            index = net.index(t, start[top], text[top])
            z, memory = net.run(net.gates(x), index, keep=True)
            target = y[some][text[top]]
            weight = np.where(target > 0, 0.5 / n1, 0.5 / n0) * len(fit) / len(top)
            chance = _sigmoid(z)
            # labels that the network can't explain lose weight, so wrong ones aren't learnt by heart
            believed = np.where(target > 0, chance, 1 - chance) ** 0.7
            g, dx = net.gradients(x, index, memory, ((chance - target) * weight * believed).astype(np.float32))
            size = np.diff(t.gram_starts)
            own = np.repeat(np.arange(len(size)), size)
            g["word"] = _scatter(word, dx[:, :WORD_DIM], len(net.p["word"]))
            g["char"] = _scatter(t.grams, dx[own, WORD_DIM:] / np.maximum(size, 1)[own, None].astype(np.float32), CHAR_ROWS)
            step += 1
            rate = 0.01 * min(1, step / 10) * (1 - 0.9 * epoch / epochs)
            for k, v in net.p.items():
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.01 * (g[k] ** 2 - second[k])
                if k in ("char", "rec", "att"):
                    v *= 1 - 0.3 * rate  # decay, so that few texts aren't learnt by heart
                v -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    _calibrate(net, [texts[i] for i in apart], y[apart])
    return net


def _calibrate(net: Network, texts: list[str], y: np.ndarray) -> None:
    """Puts the middle of the logistic curve where fewest texts fall on the wrong side, halfway in the widest such gap. A
    clean text on the toxic side counts twice."""
    top = []
    for a in range(0, len(texts), 64):
        t = tokens_of(texts[a : a + 64])
        logit, _, text = net.window_logits(t)
        best = np.full(len(t.bounds) - 1, -np.inf)
        np.maximum.at(best, text, logit)
        top.append(best)
    z = np.concatenate(top)
    z, y = z[np.isfinite(z)], y[np.isfinite(z)]
    if len(z) == 0:
        return
    order = np.argsort(z)
    z, y = z[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([2 * np.cumsum((1 - y)[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    width = np.where(wrong == wrong.min(), np.diff(edges), -1)
    k = int(np.argmax(width))
    net.middle = float((edges[k] + edges[k + 1]) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, toxic: int = 500, clean: int = 1000, longest: int = 50_000) -> list:
    """At most ``toxic`` and ``clean`` labelled texts of at most ``longest`` characters, picked by a hash of the id.

    The bound is the whole cost of training, whatever the input's size. A label that repeats for an id counts once (the
    largest), and of an id's texts the least; null ids, labels and texts are left out.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    own = own.groupBy("id").agg(F.max("y").alias("y"))
    pick = own.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(toxic).unionByName(own.where("y = 0").orderBy(F.xxhash64("id"), "id").limit(clean))
    text = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text")).where(F.length("text") <= longest)
    # at most toxic + clean rows of two numbers are broadcast
    rows = text.join(F.broadcast(pick), F.col("d") == F.col("id")).groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    return sorted(rows, key=lambda x: x.id)


def score_toxicity(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1), predicted (1 if score >= 0.5), windows, top_window (its first token).

    Every text is cut into overlapping windows of 32 tokens, 16 apart, and gets the score of its most toxic one. Null,
    empty and blank texts have no window and get the prior. Repeated rows and null ids are scored like others; no other
    column is read. An empty table gives no rows.
    """
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast(net)  # bound by the training rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "__text", 1 << 20):
            score, count, at = shared.value.score(texts.to_pylist())
            cols = [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(count), pa.array(at)]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "score", "predicted", "windows", "top_window"])

    schema = f"`{id_col}` {kind}, score double, predicted int, windows long, top_window long"
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def drop_toxic(df: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows whose text is not predicted toxic (see score_toxicity), with all their columns; nothing is shuffled."""
    names = df.columns
    shared = df.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text_col, 1 << 20):
            score, _, _ = shared.value.score(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(batch.columns, names).filter(pa.array(score < 0.5))

    return df.mapInArrow(run, df.schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Network:
    """Trains on labelled rows whose crc32(id as text) mod 5 is not 0."""
    rows = training_rows(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return train([x.text for x in rows], [x.y for x in rows])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score_toxicity`` of all documents by a network trained on the labels: doc_id, held_out (crc32(doc_id as text) mod 5
    is 0), score, predicted. Null ids are not held out; nulls, empty texts and tables as stated there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, net)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
