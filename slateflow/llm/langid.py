"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word in both directions, gives every byte position a distribution over
languages, and a document's distribution is the mean over all its positions. State starts anew at each
word, so a word's contribution is computed once for each worker and found by its hash after that, and every
byte of a whole text counts. Training is backpropagation through time in numpy with Adam.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HashTable, block_words, byte_blocks, span_hashes, tune, utf8, worker_memory, words_of

#: Longer words, as scripts without blanks have, are judged in pieces of about so many bytes, each read with CONTEXT bytes on both sides.
WORD_BYTES, CONTEXT = 64, 16
HIDDEN, EPOCHS, RATE, WORD_BATCH = 16, 6, 0.02, 256
#: Bounds of the labelled sample: documents of each language, words of each document, words of each language.
SAMPLE_DOCS, SAMPLE_WORDS, SAMPLE_LANG_WORDS = 200, 100, 6000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Direction:
    """One gated recurrent layer over byte ids, forward in time."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.n = hidden
        self.w = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)  # a byte's input to update, reset, candidate
        self.u = (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(3 * hidden, dtype=np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.w, self.u, self.b]

    def run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (words, steps, hidden) for byte ids x (words, steps)."""
        n, h = self.n, np.zeros((len(x), self.n), dtype=np.float32)
        out = np.empty((*x.shape, n), dtype=np.float32)
        for t in range(x.shape[1]):
            a = self.w[x[:, t]] + self.b
            zr = _sigmoid(a[:, : 2 * n] + h @ self.u[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(a[:, 2 * n :] + (r * h) @ self.u[:, 2 * n :])
            if keep is not None:
                keep.append((h, z, r, c))
            h = h + z * (c - h)
            out[:, t] = h
        return out

    def states(self, x: np.ndarray) -> np.ndarray:
        """run() for prediction: states by step (steps, words, hidden), computed in place."""
        n, w = self.n, self.w + self.b
        out = np.zeros((x.shape[1] + 1, len(x), n), dtype=np.float32)
        gates, inner = np.ascontiguousarray(self.u[:, : 2 * n]), np.ascontiguousarray(self.u[:, 2 * n :])
        for t in range(x.shape[1]):
            h, a = out[t], w[x[:, t]]
            zr = h @ gates
            zr += a[:, : 2 * n]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            c = (zr[:, n:] * h) @ inner
            c += a[:, 2 * n :]
            np.tanh(c, out=c)
            c -= h
            c *= zr[:, :n]
            np.add(h, c, out=out[t + 1])
        return out[1:]

    def back(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of w, u, b, given those of every state."""
        n, gw, gu, gb = self.n, np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        dh = np.zeros((len(x), n), dtype=np.float32)
        for t in reversed(range(x.shape[1])):
            h, z, r, c = kept[t]
            dh = dh + d_out[:, t]
            dc = dh * z * (1 - c * c)
            drh = dc @ self.u[:, 2 * n :].T
            dz = dh * (c - h) * z * (1 - z)
            dr = drh * h * r * (1 - r)
            da = np.concatenate([dz, dr, dc], axis=1)
            np.add.at(gw, x[:, t], da)
            gb += da.sum(axis=0)
            gu[:, : 2 * n] += h.T @ da[:, : 2 * n]
            gu[:, 2 * n :] += (r * h).T @ dc
            dh = dh * (1 - z) + drh * r + da[:, : 2 * n] @ self.u[:, : 2 * n].T
        return [gw, gu, gb]


class ByteNetwork:
    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.fwd, self.bwd = Direction(hidden, rng), Direction(hidden, rng)
        self.v = (rng.normal(0, 1, (2 * hidden, len(langs))) / np.sqrt(2 * hidden)).astype(np.float32)
        self.c = np.zeros(len(langs), dtype=np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.fwd.params(), *self.bwd.params(), self.v, self.c]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (words, steps, languages) for words of one length."""
        s = np.concatenate([self.fwd.run(x), self.bwd.run(x[:, ::-1])[:, ::-1]], axis=2)
        return self._softmax(s @ self.v + self.c)

    def sums(self, x: np.ndarray, first: int = 0, end: int | None = None) -> np.ndarray:
        """positions() of each word summed over its steps from `first` to `end` (words, languages)."""
        n = self.fwd.n
        forth, back = self.fwd.states(x), self.bwd.states(x[:, ::-1])[::-1]
        out = np.zeros((len(x), len(self.langs)))
        for f, b in zip(forth[first:end], back[first:end]):
            out += self._softmax(f @ self.v[:n] + b @ self.v[n:] + self.c)
        return out

    @staticmethod
    def _softmax(a: np.ndarray) -> np.ndarray:
        e = np.exp(a - a.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions of words x with languages y, and its gradients."""
        kf: list = []
        kb: list = []
        s = np.concatenate([self.fwd.run(x, kf), self.bwd.run(x[:, ::-1], kb)[:, ::-1]], axis=2)
        p = self._softmax(s @ self.v + self.c)
        many = x.size
        loss = float(-np.log(np.take_along_axis(p, y[:, None, None], axis=2) + 1e-9).mean())
        d = p
        np.put_along_axis(d, y[:, None, None], np.take_along_axis(d, y[:, None, None], axis=2) - 1, axis=2)
        d /= many
        gv, gc = np.einsum("wtk,wtl->kl", s, d), d.sum(axis=(0, 1))
        ds = d @ self.v.T
        n = self.fwd.n
        gf = self.fwd.back(x, kf, ds[:, :, :n])
        gb = self.bwd.back(x[:, ::-1], kb, ds[:, ::-1, n:])
        return loss, [*gf, *gb, gv, gc]

    def train(self, words: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> float:
        rng = np.random.default_rng(seed)
        by_len: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_len.setdefault(len(w), []).append(i)
        m = [np.zeros_like(p) for p in self.params()]
        v = [np.zeros_like(p) for p in self.params()]
        step, loss = 0, 0.0
        for epoch in range(epochs):
            work = []
            for n, idx in sorted(by_len.items()):
                idx = rng.permutation(np.array(idx))
                work += [(n, idx[i : i + WORD_BATCH]) for i in range(0, len(idx), WORD_BATCH)]
            losses = []
            rate = RATE * (1 - epoch / epochs)
            for k in rng.permutation(len(work)):
                n, idx = work[k]
                x = np.frombuffer(b"".join(words[i] for i in idx), dtype=np.uint8).reshape(len(idx), n)
                got, grads = self.gradients(x, labels[idx])
                losses.append(got)
                step += 1
                for p, g, a, b in zip(self.params(), grads, m, v):
                    np.clip(g, -1, 1, out=g)
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
            loss = float(np.mean(losses))
        return loss


def cut(word: bytes) -> list[tuple[bytes, int, int]]:
    """Pieces of a word, each with its context and the part of it that counts; cut between characters."""
    if len(word) <= WORD_BYTES:
        return [(word, 0, len(word))]
    out, at = [], 0
    while at < len(word):
        end = min(at + WORD_BYTES, len(word))
        for _ in range(3):
            if end < len(word) and word[end] & 0xC0 == 0x80:
                end -= 1
        lo = max(0, at - CONTEXT)
        out.append((word[lo : end + CONTEXT], at - lo, end - lo))
        at = end
    return out


class WordScores:
    """Summed position probabilities of words, remembered by hash for up to `most` of them."""

    def __init__(self, net: ByteNetwork, most: int = 1_000_000):
        self.net, self.table = net, HashTable(most)
        self.sums = np.zeros((most, len(net.langs)), dtype=np.float32)

    def score(self, words: list[bytes]) -> np.ndarray:
        """Summed position probabilities of each word, through the network."""
        out = np.zeros((len(words), len(self.net.langs)))
        by_len: dict[tuple[int, int, int], list[tuple[int, bytes]]] = {}
        for i, w in enumerate(words):
            for p, a, b in cut(w):
                by_len.setdefault((len(p), a, b), []).append((i, p))
        for (n, a, b), group in sorted(by_len.items()):
            for lo in range(0, len(group), 1024):
                some = group[lo : lo + 1024]
                x = np.frombuffer(b"".join(p for _, p in some), dtype=np.uint8).reshape(len(some), n)
                np.add.at(out, [i for i, _ in some], self.net.sums(x, a, b))
        return out

    def block(self, buf: np.ndarray, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Summed probabilities and the number of bytes in words, of each text that begins at `at`."""
        starts, ends = block_words(buf)
        hashes = span_hashes(buf, starts, ends)
        total = np.zeros((len(starts) + 1, len(self.net.langs)))
        step = self.table.most // 4
        for a in range(0, len(starts), step):
            h = hashes[a : a + step]
            found = self.table.find(h)
            new, where, _ = self.table.unseen(h, found)
            if len(new):
                n = self.table.count + len(new)
                raw = buf.tobytes()
                self.sums[self.table.count : n] = self.score([raw[s:e] for s, e in zip(starts[a + where].tolist(), ends[a + where].tolist())])
                self.table.add(new)
                found = self.table.find(h)
            total[a + 1 : a + 1 + len(h)] = self.sums[found]
        cuts = np.r_[np.searchsorted(starts, at), len(starts)]
        size = np.r_[0, np.cumsum(ends - starts)]
        # Each text's sum by itself, so that it doesn't depend on its neighbours.
        return np.array([total[a + 1 : b + 1].sum(axis=0) for a, b in zip(cuts, cuts[1:])]).reshape(len(at), -1), np.diff(size[cuts])


def word_scores(net: ByteNetwork) -> WordScores:
    key = hashlib.sha256(b"".join(p.tobytes() for p in net.params())).digest()
    return worker_memory(("scores", key), lambda: WordScores(net))


def predict(scores: WordScores, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, mean probability) of whole texts; `und` with 0.0 for null or no letter. Ties go to the first language in order."""
    sums, size = np.zeros((len(texts), len(scores.net.langs))), np.zeros(len(texts))
    for buf, who, at in byte_blocks([utf8(t) if t and _LETTER.search(t) else None for t in texts]):
        s, n = scores.block(buf, at)
        np.add.at(sums, who, s)
        np.add.at(size, who, n)
    p = sums / np.maximum(size, 1)[:, None]
    best = p.argmax(axis=1)
    return [(scores.net.langs[k], float(min(1.0, p[i, k]))) if size[i] else (UNKNOWN, 0.0) for i, k in enumerate(best.tolist())]


def is_held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 0 on division by 5; false for null ids."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, seed: int = 7) -> ByteNetwork | None:
    """Train on a bounded sample of labelled documents outside the held-out fold; None if no document has a label.

    SAMPLE_DOCS documents of each language, those with the smallest hash of the id; SAMPLE_WORDS words of
    each, at even distances over the whole text. Of rows that repeat an id and its language one counts, that
    with the smallest text. Only this sample reaches the driver. An empty table gives None.
    """
    rows = docs.where(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang").withColumn("_n", F.dense_rank().over(w)).where(F.col("_n") <= SAMPLE_DOCS).select("doc_id").distinct()
    chosen = [r["doc_id"] for r in ids.collect()]
    if not chosen:
        return None

    def sample(frames):
        for pdf in frames:
            out = []
            for d, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"]):
                w = words_of(text)
                pick = [w[i * len(w) // SAMPLE_WORDS] for i in range(SAMPLE_WORDS)] if len(w) > SAMPLE_WORDS else w
                out += [(d, lang, i, p) for i, x in enumerate(pick) for p, _, _ in cut(x)]
            yield pd.DataFrame(out, columns=["doc_id", "lang", "i", "word"])

    one = rows.where(F.col("doc_id").isin(chosen)).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = one.select("doc_id", "lang", "text").mapInPandas(sample, "doc_id long, lang string, i int, word binary").toPandas()
    if not len(got):
        return None
    got["word"] = got["word"].map(bytes)
    got = got.sort_values(["lang", "doc_id", "i", "word"], kind="stable")
    langs = sorted(got["lang"].unique())
    words: list[bytes] = []
    labels: list[int] = []
    rng = np.random.default_rng(seed)
    for k, lang in enumerate(langs):
        own = got.loc[got["lang"] == lang, "word"].tolist()
        pick = rng.choice(len(own), SAMPLE_LANG_WORDS, replace=len(own) < SAMPLE_LANG_WORDS)  # languages weigh alike
        words += [own[i] for i in np.sort(pick)]
        labels += [k] * len(pick)
    net = ByteNetwork(langs, seed=seed)
    net.train(words, np.array(labels), seed=seed)
    return net


def prediction(net: ByteNetwork | None):
    """The network as a function of a text column: struct (lang_pred, score). Other columns don't pass through Python."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = word_scores(net) if net else None
        for x in texts:
            got = predict(scores, x.tolist()) if scores is not None else [(UNKNOWN, 0.0)] * len(x)
            yield pd.DataFrame(got, columns=["lang_pred", "score"])

    return F.pandas_udf(run, "lang_pred string, score double")


def identify(docs: DataFrame, net: ByteNetwork | None) -> DataFrame:
    """doc_id, lang_pred and score for every row of docs (doc_id, text); other columns play no part.

    Null text, empty text and text without a letter: `und`, 0.0; so is all if nothing could be learned. Repeated
    rows are judged alike, and an empty table gives no rows.
    """
    tune(docs.sparkSession)
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), prediction(net)(F.col("text").cast("string")).alias("p"))
    return got.select("doc_id", "p.lang_pred", "p.score")


def keep_known(docs: DataFrame, net: ByteNetwork | None, least: float) -> DataFrame:
    """The rows of `docs`, all columns, that have a known language with at least this score."""
    tune(docs.sparkSession)
    names = docs.columns
    rows = docs.toDF(*[f"c_{i}" for i in range(len(names))])  # names of its own, so that none clashes
    text = F.col(f"c_{names.index('text')}").cast("string")
    rows = rows.withColumn("p", prediction(net)(text)).where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least))
    return rows.drop("p").toDF(*names)


def op10_byte_gru(spark: SparkSession, docs: DataFrame) -> DataFrame:
    net = fit(docs)
    out = identify(docs, net)
    return out.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
