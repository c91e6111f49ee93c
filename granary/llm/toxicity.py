"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word's input sums its embedding, that of its first `STEM` bytes (one for all that training met in fewer than
`KNOWN` documents) and the mean of its hashed character-trigram embeddings.
A GRU reads each window of words in both directions, attention pools its states, and a logistic unit
gives the window's score. All windows of `WINDOW` words that begin at every `STRIDE`th word are scored, so each
overlaps the next by half; a text's score is its greatest window score, calibrated on texts that did not train it.

Training (numpy, driver) uses at most `PER_CLASS` labelled documents of each class, chosen by a hash among
those of at most `MOST_CHARS` code points: the documented bound of the sample. Their whole texts are read. All weights and
embeddings start at random. In the first `WARM` rounds a few windows of each document carry its label; from then on a
document is represented by the window that the network scores highest, so labels of whole documents suffice.

Null and empty texts, and texts without words, get the score of an empty window. Without labels of both classes
all scores are the share of label 1 (0 if there are none). Repeated labels of a doc_id count by their greatest
value, repeated rows of a sampled doc_id by their least text. Texts of more than `SLICE` words are scored in overlapping
slices with the same windows. Repeated rows each get their row; extra columns are carried by `score`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pieces, settled, shipped
from .wordfeatures import Words, chains, sliced

PER_CLASS, MOST_CHARS = 700, 50_000
WINDOW, STRIDE, THRESHOLD, SLICE = 32, 16, 0.7, 1 << 17
STEM, GRAMS, DIM, HIDDEN, ATTEND = 6, 1 << 12, 16, 12, 8
ROUNDS, WARM, PER_DOC, BATCH, RATE, SHRINK, DROP, KNOWN, BACK = 9, 6, 12, 128, 0.01, 1e-3, 0.5, 4, 5
TABLES = ("word", "stem", "gram")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Net:
    """Parameters by name, forward and backward passes over (windows, words, inputs)."""

    def __init__(self, known: np.ndarray, stems: np.ndarray, seed: int = 0):
        """known, stems: sorted hashes of words and stems that training met in two documents or more; others share one embedding."""
        rng = np.random.RandomState(seed)
        self.known, self.stems = known, stems
        g = lambda *s, k=1.0: (rng.randn(*s) * k / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "word": (rng.randn(len(known) + 1, DIM) * 0.05).astype(np.float32),
            "stem": (rng.randn(len(stems) + 1, DIM) * 0.05).astype(np.float32), "gram": (rng.randn(GRAMS, DIM) * 0.05).astype(np.float32)
        }
        for d in "fb":
            self.p |= {f"W{d}": g(DIM, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": g(HIDDEN, 3 * HIDDEN)}
        self.p |= {"A": g(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": g(ATTEND), "o": g(2 * HIDDEN), "k": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    @staticmethod
    def entries(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(table, hashes)
        hit = table[np.minimum(at, len(table) - 1)] == hashes if len(table) else np.zeros(len(hashes), bool)
        return np.where(hit, at, len(table))

    def inputs(self, words: Words) -> np.ndarray:
        """The input vector of each distinct word."""
        grams, offs = words.trigrams(GRAMS)
        x = self.p["word"][self.entries(self.known, words.hashes)] + self.p["stem"][self.entries(self.stems, words.stems(STEM))]
        return x + np.add.reduceat(self.p["gram"][grams], offs, axis=0) / words.length[:, None].astype(np.float32) if len(offs) else x

    def run(self, proj: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. proj: of each distinct word its gate inputs by direction; index: (n, t) words."""
        n, t_max = index.shape
        h2 = 2 * HIDDEN
        states, trace = np.zeros((n, t_max, h2), np.float32), {}
        for d in "fb":
            u, h, seen = self.p[f"U{d}"], np.zeros((n, HIDDEN), np.float32), []
            for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
                a, b = proj[d][index[:, t]], h @ u
                zr = _sigmoid(a[:, :h2] + b[:, :h2])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(a[:, h2:] + r * b[:, h2:])
                new = h + (z * (c - h)) * mask[:, t : t + 1]
                if keep:
                    seen.append((t, h, z, r, c, b[:, h2:]))
                h = new
                states[:, t, slice(0, HIDDEN) if d == "f" else slice(HIDDEN, h2)] = h
            trace[d] = seen
        q = np.tanh(states @ self.p["A"] + self.p["a"])
        e = q @ self.p["v"] + (mask - 1) * 1e4
        w = np.exp(e - e.max(1, keepdims=True)) * mask
        w /= np.maximum(w.sum(1, keepdims=True), 1e-9)
        pooled = (w[:, :, None] * states).sum(1)
        logit = pooled @ self.p["o"] + self.p["k"][0]
        return (logit, states, q, w, pooled, trace) if keep else logit

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}

    def gradients(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Loss, gradients by name, and the gradient of the distinct words' inputs x."""
        proj = self.project(x)
        logit, states, q, w, pooled, trace = self.run(proj, index, mask, keep=True)
        p, h2 = self.p, 2 * HIDDEN
        loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum())
        dl = (weight * (_sigmoid(logit) - y)).astype(np.float32)
        g = {"o": pooled.T @ dl, "k": np.array([dl.sum()], np.float32)}
        dpool = dl[:, None] * p["o"]
        dw = (states * dpool[:, None, :]).sum(2)
        de = w * (dw - (w * dw).sum(1, keepdims=True))
        g["v"] = np.einsum("nt,nta->a", de, q)
        dq = de[:, :, None] * p["v"] * (1 - q * q)
        g["A"], g["a"] = np.einsum("nth,nta->ha", states, dq), dq.sum((0, 1))
        dstates = w[:, :, None] * dpool[:, None, :] + dq @ p["A"].T
        dx = np.zeros_like(x)
        for d in "fb":
            u, du = p[f"U{d}"], np.zeros_like(p[f"U{d}"])
            dproj = np.zeros_like(proj[d])
            dh = np.zeros((len(index), HIDDEN), np.float32)
            for t, h, z, r, c, bc in reversed(trace[d]):
                dh = dh + dstates[:, t, slice(0, HIDDEN) if d == "f" else slice(HIDDEN, h2)]
                m = mask[:, t : t + 1]
                dn = dh * m
                dc = dn * z * (1 - c * c)
                dz = dn * (c - h) * z * (1 - z)
                dr = dc * bc * r * (1 - r)
                da = np.concatenate([dz, dr, dc], 1)
                db = np.concatenate([dz, dr, dc * r], 1)
                du += h.T @ db
                np.add.at(dproj, index[:, t], da)
                dh = dh - dn * z + db @ u.T
            g[f"U{d}"], g[f"W{d}"], g[f"c{d}"] = du, x.T @ dproj, dproj.sum(0)
            dx += dproj @ p[f"W{d}"].T
        return loss, g, dx

    def windows(self, words: Words, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, length, row = chains(words.row, words.rows, WINDOW, stride)
        at = first[:, None] + np.arange(WINDOW)
        mask = (np.arange(WINDOW) < length[:, None]).astype(np.float32)
        return words.inverse[np.minimum(at, max(0, len(words) - 1))] if len(words) else np.zeros((0, WINDOW), np.int64), mask, row

    def logits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every overlapping window its logit and text; and the windows themselves."""
        index, mask, row = self.windows(words)
        proj = self.project(self.inputs(words))
        out = np.zeros(len(row), np.float32)
        for at in range(0, len(row), 4096):
            out[at : at + 4096] = self.run(proj, index[at : at + 4096], mask[at : at + 4096])
        return out, row, index, mask

    def best(self, logit: np.ndarray, row: np.ndarray, rows: int, without: float | None = None) -> np.ndarray:
        """Of each text its greatest window logit; without windows that of an empty one, or the given number."""
        top = np.full(rows, -np.inf)
        np.maximum.at(top, row, logit)
        return np.where(np.isfinite(top), top, float(self.p["k"][0]) if without is None else without)

    def texts(self, column) -> np.ndarray:
        """The score of each text, 0 to 1."""
        top = np.full(len(column), -np.inf)
        for rows, part, _, _ in sliced(column, SLICE, WINDOW - STRIDE):
            words = Words(part)
            logit, row, _, _ = self.logits(words)
            top[rows] = np.maximum(top[rows], self.best(logit, row, words.rows, -np.inf))
        return _sigmoid(self.scale * np.where(np.isfinite(top), top, self.p["k"][0]) + self.shift)


def train(samples: list[tuple[str, int]], share: float, seed: int = 0) -> Net | float:
    """samples: (text, label); share: of label 1 among all labelled rows. A number if there is nothing to learn."""
    y = np.array([t for _, t in samples], np.float32)
    if len(set(y)) < 2:
        return share
    rng = np.random.RandomState(seed)
    words = Words([t for t, _ in samples])
    if not len(words):
        return share
    # every BACKth text of a class, in random order, only calibrates
    back = np.zeros(len(y), bool)
    for label in (0, 1):
        back[rng.permutation(np.flatnonzero(y == label))[BACK - 1 :: BACK]] = True
    net, stem_of = _initial(words, ~back, seed)
    slot = net.entries(net.known, words.hashes)
    grams, offs = words.trigrams(GRAMS)
    per_gram = np.repeat(1.0 / words.length, words.length).astype(np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    prior = y.mean()
    class_weight = np.where(y == 1, 0.5 / prior, 0.5 / (1 - prior))
    index, mask, row = net.windows(words)

    def logits() -> np.ndarray:
        proj = net.project(net.inputs(words))
        return np.concatenate([net.run(proj, index[at : at + 4096], mask[at : at + 4096]) for at in range(0, len(row), 4096)])

    def step(part: np.ndarray, rate: float, steps: int) -> None:
        word, local = np.unique(index[part], return_inverse=True)
        counts = words.length[word]
        inner = np.cumsum(counts) - counts
        flat_at = np.repeat(offs[word] - inner, counts) + np.arange(counts.sum())
        g_ids, g_w = grams[flat_at], per_gram[flat_at]
        lost = (rng.rand(len(word), 1) < DROP).astype(np.float32)  # a word is now and then known by its parts alone
        x = net.p["word"][slot[word]] * (1 - lost) + net.p["stem"][stem_of[word]] + np.add.reduceat(
            net.p["gram"][g_ids] * g_w[:, None], inner, axis=0
        )
        w = class_weight[row[part]]
        _, g, dx = net.gradients(x, local.reshape(len(part), WINDOW), mask[part], y[row[part]], (w / w.sum()).astype(np.float32))
        g |= {k: np.zeros_like(net.p[k]) for k in TABLES}
        np.add.at(g["word"], slot[word], dx * (1 - lost))
        np.add.at(g["stem"], stem_of[word], dx)
        np.add.at(g["gram"], g_ids, np.repeat(dx, counts, axis=0) * g_w[:, None])
        for k, v in net.p.items():
            m1, m2 = moments[k]
            m1 += 0.1 * (g[k] - m1)
            m2 += 0.01 * (g[k] ** 2 - m2)
            v -= rate * (m1 / (1 - 0.9**steps) / (np.sqrt(m2 / (1 - 0.99**steps)) + 1e-6) + SHRINK * v).astype(np.float32)

    steps = 0
    for nth in range(ROUNDS):
        # first every window speaks for its document, a few of each; then the one that the network scores highest
        order = np.lexsort((rng.rand(len(row)) if nth < WARM else logits(), row))
        rank = np.arange(len(row)) - np.searchsorted(row[order], row[order], "left")
        rank = np.bincount(row, minlength=len(y))[row[order]] - 1 - rank
        chosen = order[(rank < (PER_DOC if nth < WARM else 1)) & ~back[row[order]]]
        if nth >= WARM:
            clean = np.flatnonzero((y[row] == 0) & ~back[row])
            chosen = np.concatenate([chosen, rng.permutation(clean)[: len(chosen)]])
        chosen = rng.permutation(chosen)
        for at in range(0, len(chosen), BATCH):
            steps += 1
            step(chosen[at : at + BATCH], RATE * (1 - nth / ROUNDS), steps)
    net.scale, net.shift = _calibrated(net.best(logits(), row, len(y))[back], y[back], share) if len(set(y[back])) == 2 else (1.0, 0.0)
    return net


def _initial(words: Words, learn: np.ndarray, seed: int) -> tuple[Net, np.ndarray]:
    """An untrained network that knows the words and stems of KNOWN documents or more, and each word's stem entry."""
    stems, stem_of = np.unique(words.stems(STEM), return_inverse=True)

    def often(kind: np.ndarray, most: int) -> np.ndarray:
        docs = np.unique(np.stack([kind[words.inverse], words.row])[:, learn[words.row]], axis=1)
        return np.bincount(docs[0], minlength=most) >= KNOWN

    net = Net(words.hashes[often(np.arange(len(words.hashes)), len(words.hashes))], stems[often(stem_of, len(stems))], seed)
    return net, net.entries(net.stems, stems)[stem_of]


def _calibrated(best: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Scale and shift: logistic regression of the label on a text's greatest logit, at the labels' own share."""
    prior = y.mean()
    w = np.where(y == 1, share / prior, (1 - share) / (1 - prior))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps
        p = _sigmoid(a * best + b)
        h = w * p * (1 - p) + 1e-9
        grad = np.array([(w * (p - y) * best).sum() + 1e-2 * (a - 1), (w * (p - y)).sum()])
        hess = np.array([[(h * best * best).sum() + 1e-2, (h * best).sum()], [(h * best).sum(), h.sum() + 1e-6]])
        change = np.linalg.solve(hess, grad)
        a, b = float(np.clip(a - np.clip(change[0], -1, 1), 0.05, 20)), float(b - np.clip(change[1], -2, 2))
    return a, b


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[tuple[str, int]], float]:
    """At most per_class labelled texts of each class that may be learned from, and label 1's share of all such labels."""
    open_ = labels.where(~F.coalesce(held_out("doc_id"), F.lit(True)) & F.col("toxic").isin(0, 1))
    open_ = open_.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    fit = docs.where(F.length("text") <= MOST_CHARS).select("doc_id").distinct()
    open_ = settled(open_.join(fit, "doc_id"), "toxic-labels")
    sizes = {r["toxic"]: r["n"] for r in open_.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], 0.0
    picked = None
    for label in sizes:  # top-k by hash: at most 2 * per_class ids
        part = open_.where(F.col("toxic") == label).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: r["doc_id"])], sizes.get(1, 0) / sum(sizes.values())


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in pieces(batches, "text"):
            out = np.full(batch.num_rows, float(net)) if isinstance(net, float) else net.texts(batch.column(batch.schema.get_field_index("text")))
            keep = [c for c in batch.schema.names if c != "toxicity"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(np.clip(out.astype(np.float64), 0, 1))],
                [*keep, "toxicity"]
            )

    return run


def score(docs: DataFrame, net: Net | float) -> DataFrame:
    """docs with toxicity, 0 to 1."""
    docs = shipped(docs).drop("toxicity")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "toxicity double"])
    return docs.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(net)), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    net = train(*sample(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(rows, net).select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted")
    )
