"""Language identification of code-switched text by a linear-chain conditional random field.

Each word's emission sums learned weights of its affixes (1 to 4 bytes), its byte trigrams (^word$)
and a lexicon entry if training knew the word; transitions between the labels of neighbouring
words are learned too. A text is one chain. Forward-backward gives each word's label posteriors; a text's language is
the label with the greatest mean over its words with letters, and that mean is the score. So every word of
the whole text counts.

Chains are worked on in blocks of `BLOCK` words side by side: the product of a block's moves and emissions tells what
its neighbours send into it, so the posteriors are those of the whole chain. Texts of more than `SLICE` words are read in
slices that overlap by `EDGE` words, over which a chain forgets its start.

Training (numpy, driver) takes at most `PER_LANG` documents a language, chosen by a hash among those of at most
`MOST_CHARS` code points: the documented bound of the labelled sample. Their whole texts are read. Training chains
splice runs of several languages, from which the transitions of code-switching are learned. Every language of
the open labels is learned, so the sample grows with the number of languages.

Texts that are null or have no letter are `und` with score 0. If nothing can be learned all are. Ties go
to the first label in order. Repeated rows each get their row; extra columns are carried by `label`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pieces, shipped
from .wordfeatures import Words, chains, sliced

PER_LANG, MOST_CHARS, BLOCK, SLICE, EDGE = 200, 20_000, 128, 1 << 17, 256
#: Hashed features; training rounds, step and shrinkage.
FEATURES, ROUNDS, STEP, SHRINK = 1 << 15, 25, 0.08, 1e-4
UND = "und"


class Crf:
    def __init__(self, labels: list[str], lexicon: np.ndarray):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.affix = np.zeros((FEATURES, k), np.float32)
        self.gram = np.zeros((FEATURES, k), np.float32)
        self.entry = np.zeros((len(lexicon) + 1, k), np.float32)
        self.bias = np.zeros(k, np.float32)
        self.moves = np.zeros((k, k), np.float32)

    def features(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        grams, offs = words.trigrams(FEATURES)
        at = np.minimum(np.searchsorted(self.lexicon, words.hashes), max(0, len(self.lexicon) - 1))
        entry = np.where(self.lexicon[at] == words.hashes, at, len(self.lexicon)) if len(self.lexicon) else np.zeros(len(words.hashes), np.int64)
        return words.affixes(FEATURES), grams, offs, words.length, entry

    def emissions(self, f) -> np.ndarray:
        """Of each distinct word its score for each label."""
        affix, grams, offs, n, entry = f
        out = self.bias + self.entry[entry]
        if len(n):
            out = out + self.affix[affix].mean(1) + np.add.reduceat(self.gram[grams], offs, axis=0) / n[:, None]
        return out.astype(np.float32)

    def entering(self, e: np.ndarray, m: np.ndarray, first: np.ndarray, length: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What reaches each block's first word from the left and its last word from the right, of blocks that follow each other
        where they have the same row."""
        n, k = len(first), e.shape[1]
        left, right = np.ones((n, k), np.float32), np.ones((n, k), np.float32)
        nth = np.arange(n) - np.searchsorted(row, row)  # of a row's blocks
        many = np.flatnonzero(np.bincount(row)[row] > 1)
        if not len(many):
            return left, right
        moved = np.tile(np.eye(k, dtype=np.float32), (len(many), 1, 1))
        for t in range(int(length[many].max())):
            live = np.flatnonzero(t < length[many])
            step = (moved[live] @ m) * e[first[many[live]] + t][:, None, :]
            moved[live] = step / step.sum((1, 2), keepdims=True)
        at = np.full(n, -1)
        at[many] = np.arange(len(many))
        last = nth == np.bincount(row)[row] - 1
        # the first block of a row starts with its emission alone: as if all labels came before with no preference
        for j in range(1, int(nth.max()) + 1):
            b = np.flatnonzero(nth == j)
            x = left[b - 1] if j > 1 else None
            if x is None:  # a chain's first word has no move before it
                f = first[b - 1]
                a = e[f]
                for t in range(1, int(length[b - 1].max())):
                    go = np.flatnonzero(t < length[b - 1])
                    y = (a[go] @ m) * e[f[go] + t]
                    a[go] = y / y.sum(1, keepdims=True)
            else:
                a = np.einsum("nk,nkl->nl", carried[np.searchsorted(before, b - 1)], moved[at[b - 1]])
            carried, before = a / a.sum(1, keepdims=True), b
            left[b] = carried @ m
        for j in range(int(nth.max()) - 1, -1, -1):
            b = np.flatnonzero((nth == j) & ~last)
            x = np.einsum("nkl,nl->nk", moved[at[b + 1]], right[b + 1])
            right[b] = x / x.sum(1, keepdims=True)
        return left, right

    def posteriors(self, scores: np.ndarray, first: np.ndarray, length: np.ndarray, row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Label posteriors of each word and the expected moves, over chains of words at first .. first+length.

        scores: (words, labels); the chains must cover each word once. row: blocks of one row are one chain (its moves
        between blocks are not counted)."""
        k = len(self.labels)
        out = np.zeros((len(scores), k), np.float32)
        pairs = np.zeros((k, k))
        if not len(first):
            return out, pairs
        e, m = np.exp(scores - scores.max(1, keepdims=True)), np.exp(self.moves)
        left = right = np.ones((len(first), k), np.float32)
        if row is not None:
            left, right = self.entering(e, m, first, length, row)
        order = np.argsort(-length, kind="stable")
        first, length, left, right = first[order], length[order], left[order], right[order]
        t_max = int(length[0])
        live = np.searchsorted(-length, -np.arange(t_max), "left")  # chains longer than t
        alpha = []
        a = e[first] * left
        a /= a.sum(1, keepdims=True)
        alpha.append(a)
        for t in range(1, t_max):
            a = (a[: live[t]] @ m) * e[first[: live[t]] + t]
            a /= a.sum(1, keepdims=True)
            alpha.append(a)
        b = right.copy()
        for t in range(t_max - 1, -1, -1):
            n = live[t]
            g = alpha[t] * b[:n]
            g /= g.sum(1, keepdims=True)
            out[first[:n] + t] = g
            back = e[first[:n] + t] * b[:n]
            if t:
                if row is None:
                    x = alpha[t - 1][:n]
                    joint_norm = ((x @ m) * back).sum(1, keepdims=True)
                    pairs += m * ((x / joint_norm).T @ back)
                nb = back @ m.T
                b[:n] = nb / nb.sum(1, keepdims=True)
        return out, pairs

    def texts(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text's words with letters the mean posteriors, the mean of each word's own greatest one, and their number."""
        k = len(self.labels)
        total, sure, n = np.zeros((len(column), k)), np.zeros(len(column)), np.zeros(len(column))
        for rows, part, begins, ends in sliced(column, SLICE, EDGE):
            words = Words(part)
            if not len(words):
                continue
            scores = self.emissions(self.features(words))[words.inverse]
            post, _ = self.posteriors(scores, *chains(words.row, words.rows, BLOCK))
            own = words.letter.copy()
            if not begins:  # half of an overlap counts in each of its slices
                own[: EDGE // 2] = False
            if not ends:
                own[-(EDGE // 2) :] = False
            total[rows] += np.stack([np.bincount(words.row[own], post[own, j], words.rows) for j in range(k)], 1)
            sure[rows] += np.bincount(words.row[own], post[own].max(1), words.rows)
            n[rows] += np.bincount(words.row[own], minlength=words.rows)
        return total / np.maximum(n, 1)[:, None], sure / np.maximum(n, 1), n


def train(samples: list[tuple[str, str]], seed: int = 0) -> Crf | None:
    """samples: (text, language)."""
    labels = sorted({lang for _, lang in samples})
    if not labels:
        return None
    rng = np.random.RandomState(seed)
    runs: dict[int, list[list[str]]] = {k: [] for k in range(len(labels))}
    for text, lang in samples:
        w = text.split()
        while w:
            n = rng.randint(8, 33)
            runs[labels.index(lang)].append(w[:n])
            w = w[n:]
    pool = [(k, r) for k, v in runs.items() for r in v]
    rng.shuffle(pool)
    texts, tags, i = [], [], 0
    while i < len(pool):  # chains of one to three runs
        n = rng.randint(1, 4)
        part = pool[i : i + n]
        texts.append(" ".join(" ".join(r) for _, r in part))
        tags.append(part)
        i += n
    words = Words(texts)
    if not len(words):
        return None
    gold = np.concatenate([np.full(len(Words([" ".join(r)])), k) for part in tags for k, r in part])
    counts = np.bincount(words.inverse, minlength=len(words.hashes))
    crf = Crf(labels, words.hashes[counts >= 3])
    f = crf.features(words)
    affix, grams, offs, n, entry = f
    first, length, _ = chains(words.row, words.rows, 3 * 33)
    k = len(labels)
    weight = np.repeat(1.0 / np.maximum(n, 1), n)
    rise = {name: np.zeros_like(getattr(crf, name)) for name in ("affix", "gram", "entry", "bias", "moves")}
    gold_moves = np.zeros((k, k))
    inner = words.row[1:] == words.row[:-1]
    np.add.at(gold_moves, (gold[:-1][inner], gold[1:][inner]), 1)
    balance = len(gold) / (k * np.maximum(1, np.bincount(gold, minlength=k)))
    for _ in range(ROUNDS):
        post, pairs = crf.posteriors(crf.emissions(f)[words.inverse], first, length)
        miss = -post
        miss[np.arange(len(gold)), gold] += 1
        miss *= balance[gold][:, None]
        per_word = np.stack([np.bincount(words.inverse, miss[:, j], len(words.hashes)) for j in range(k)], 1)
        spread = np.repeat(per_word, n, axis=0) * weight[:, None]
        change = {
            "affix": np.stack(
                [np.bincount(affix.ravel(), np.repeat(per_word[:, j], affix.shape[1]) / affix.shape[1], FEATURES) for j in range(k)], 1
            ),
            "gram": np.stack([np.bincount(grams, spread[:, j], FEATURES) for j in range(k)], 1),
            "entry": np.stack([np.bincount(entry, per_word[:, j], len(crf.lexicon) + 1) for j in range(k)], 1), "bias": per_word.sum(0),
            "moves": gold_moves - pairs,
        }
        for name, g in change.items():
            value = getattr(crf, name)
            g = g - SHRINK * len(gold) / FEATURES * value
            rise[name] += g * g
            value += (STEP * 4 * g / (np.sqrt(rise[name]) + 1e-6)).astype(np.float32)
    return crf


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """At most per_lang labelled texts of each language that may be learned from, by a hash of doc_id."""
    open_ = docs.where(~F.coalesce(held_out("doc_id"), F.lit(True)) & F.col("lang").isNotNull() & (F.length("text") <= MOST_CHARS))
    order = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30))
    open_ = open_.select("doc_id", "lang", "text", order.alias("o"))
    sizes = open_.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n"))
    # about as many of each language as asked, however many there are
    picked = open_.join(sizes, F.col("lang") == F.col("l")).where(F.col("o") < (1 << 30) * (1.2 * per_lang) / F.col("n"))
    out: list[tuple[str, str]] = []
    taken: dict[str, int] = {}
    for r in sorted(picked.select("o", "lang", "text").collect(), key=lambda r: (r["o"], r["lang"], r["text"])):
        if taken.setdefault(r["lang"], 0) < per_lang:
            taken[r["lang"]] += 1
            out.append((r["text"], r["lang"]))
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


_ADDED = {"lang_pred": "string", "lang_score": "double", "lang_sure": "double"}


def _labeller(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in pieces(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text"))
            lettered = np.array([has_letter(t) for t in texts.to_pylist()], bool)
            names, scores, sure = np.full(batch.num_rows, UND, object), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            if crf is not None:
                mean, certain, n = crf.texts(texts)
                best = mean.argmax(1)
                lettered &= n > 0
                names[lettered] = np.array(crf.labels, object)[best[lettered]]
                scores[lettered] = np.clip(mean[np.arange(len(best)), best], 0, 1)[lettered]
                sure[lettered] = np.clip(certain, 0, 1)[lettered]
            keep = [c for c in batch.schema.names if c not in _ADDED]
            new = [pa.array(names.tolist(), pa.string()), pa.array(scores), pa.array(sure)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *new], [*keep, *_ADDED])

    return run


def label(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """docs with lang_pred, lang_score, and lang_sure: how sure the model is of each word's language, on average."""
    docs = shipped(docs).drop(*_ADDED)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"{c} {kind}" for c, kind in _ADDED.items())])
    return docs.mapInArrow(_labeller(docs.sparkSession.sparkContext.broadcast(crf)), schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    crf = train(sample(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return label(rows, crf).select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
