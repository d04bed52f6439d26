"""Convolutional text classifier: hashed word embeddings (the sum of those of a word and of its first
four and five letters), filters of widths 1 to 3, max pooling over the whole text and a logistic
output, trained in numpy. Its decision threshold is calibrated for
each language as the text itself tells it (see langid), and the score is shifted so that the
threshold lies at 0.5.

Null texts: as empty; an empty text has the score of the output's bias. Repeated rows: a result row
each. Empty table: empty. Without labels of both kinds the score is the share of toxic labels.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import langid
from tidemill.llm.base import Scratch, WordTable, flat_words, gathered, held_out, sampled, segment_sum, text_slices, workers_ready

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 12, (1, 2, 3)
BEGINNINGS = (4, 5)
#: Most labelled documents that training reads, about, and their bytes; ones longer than langid.TRAIN_BYTES aren't learnt from.
TRAIN_DOCS, TRAIN_TOTAL = 6000, 24 << 20
TRIM = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass
class ToxicityModel:
    rows: np.ndarray  # bucket -> row of the embeddings; 0: unknown, a zero vector
    emb: np.ndarray
    taps: dict[int, np.ndarray]  # width -> width x DIM x FILTERS
    shift: np.ndarray
    out: np.ndarray
    bias: float
    language: langid.LanguageModel | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5
    key: str = ""


def split(text: bytes) -> list[bytes]:
    return text.lower().split()


def buckets(words: list[bytes]) -> np.ndarray:
    """Hashes of each word without punctuation at its ends, and of its beginnings: words x 3."""
    out = np.empty((len(words), 1 + len(BEGINNINGS)), np.int64)
    for i, w in enumerate(words):
        w = w.strip(TRIM)
        text = w.decode("utf-8", "replace") if not w.isascii() else None
        out[i, 0] = xxhash.xxh32_intdigest(w) % BUCKETS
        for k, n in enumerate(BEGINNINGS, 1):
            out[i, k] = xxhash.xxh32_intdigest(w[:n] if text is None else text[:n].encode(), seed=n) % BUCKETS
    return out


_tables_of: dict[str, WordTable] = {}


def _features(m: ToxicityModel, words: list[bytes]) -> np.ndarray:
    """A word's vector, then its features for the language model, if there is one."""
    vectors = m.emb[m.rows[buckets(words)]].sum(axis=1)
    if m.language is None or not m.language.langs:
        return vectors
    parts, starts = flat_words(words, langid.split)  # a word of other white space is several there
    return np.concatenate([vectors, segment_sum(langid.word_features(m.language, parts), starts)], axis=1)


def _embedded(m: ToxicityModel) -> WordTable:
    """The worker's table of word features for this model."""
    if m.key not in _tables_of:
        _tables_of.clear()
        _tables_of[m.key] = WordTable(lambda words: _features(m, words))
    return _tables_of[m.key]


def _padded(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zeros after each text, so that no filter reaches into the next one; where the texts then start,
    and where the positions end at which a filter may stand (one at least)."""
    pad, sizes = max(WIDTHS) + 1, np.diff(starts)
    first = starts[:-1] + pad * np.arange(len(sizes))
    out = np.zeros((len(x) + pad * len(sizes), *x.shape[1:]), x.dtype)
    out[np.arange(len(x)) + pad * np.repeat(np.arange(len(sizes)), sizes)] = x
    return out, first, first + np.maximum(sizes, 1)


def _convolved(m: ToxicityModel, x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    conv = x[:n] @ m.taps[w][0]
    for j in range(1, w):
        conv += x[j : j + n] @ m.taps[w][j]
    return conv


def _answers(m: ToxicityModel, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log-odds of texts from their words' vectors."""
    x, first, end = _padded(x, starts)
    bounds = np.stack([first, end], axis=1).ravel()
    pooled = np.concatenate([np.maximum.reduceat(_convolved(m, x, w), bounds, axis=0)[::2] for w in WIDTHS], axis=1)
    return np.maximum(pooled + m.shift, 0) @ m.out + m.bias


def raw_scores(m: ToxicityModel, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds before calibration, and the number of each text's language (-1: none)."""
    if not texts:
        return np.zeros(0), np.zeros(0, int)
    words, starts = flat_words(texts, split)
    x = _embedded(m).of(words) if words else np.zeros((0, DIM), np.float32)
    lang = np.full(len(texts), -1)
    if x.shape[1] > DIM:
        lang = langid.answers(m.language, segment_sum(x[:, DIM:].astype(np.float64), starts))[0]
    return _answers(m, np.ascontiguousarray(x[:, :DIM]), starts), lang


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Log-odds with the best F1: the middle of the range of thresholds that reach it."""
    order = np.argsort(-z)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    low = z[order][min(top[-1] + 1, len(y) - 1)]
    return float((z[order][top[0]] + low) / 2)


def train(texts: list[bytes], labels: np.ndarray, language: langid.LanguageModel | None = None, epochs: int | None = None, seed: int = 3) -> ToxicityModel:
    y, rng = np.asarray(labels, np.float32), np.random.default_rng(seed)
    base = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    epochs = epochs or int(np.clip(60_000 / max(1, len(texts)), 8, 60))
    table = WordTable(buckets, most=1 << 40)
    docs = [table.ids(split(t)) for t in texts]  # numbers of words
    triples = table.rows[: len(table.index)] if len(table.index) else np.zeros((0, 1 + len(BEGINNINGS)), np.int64)
    df = np.zeros(BUCKETS, np.int64)
    for d in docs:
        df[np.unique(triples[np.unique(d)])] += 1
    seen = np.flatnonzero(df >= (2 if len(texts) < 1500 else 4))
    rows = np.zeros(BUCKETS, np.int64)
    rows[seen] = np.arange(1, len(seen) + 1)
    emb = np.concatenate([np.zeros((1, DIM)), rng.normal(0, 0.1, (len(seen), DIM))]).astype(np.float32)
    taps = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    k = FILTERS * len(WIDTHS)
    m = ToxicityModel(rows, emb, taps, np.zeros(k, np.float32), rng.normal(0, 0.3, k).astype(np.float32), float(np.log(base / (1 - base))), language)
    m.key = f"{uuid.uuid4()}"
    if len(set(y.tolist())) < 2:
        m.out[:] = 0
        m.threshold = 0.0
        return m
    triples = rows[triples]
    order = rng.permutation(len(docs))
    check, fit = order[: len(order) // 6], order[len(order) // 6 :]
    weight = np.where(y == 1, min(5.0, (1 - base) / base), 1.0).astype(np.float32)
    params = {"emb": m.emb, "shift": m.shift, "out": m.out, **{f"t{w}": taps[w] for w in WIDTHS}}
    first, second, step = {n: np.zeros_like(p) for n, p in params.items()}, {n: np.zeros_like(p) for n, p in params.items()}, 0
    best, kept, stale = np.inf, None, 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
            step += 1
            ids = np.concatenate([docs[i] for i in at])
            tri, begin, end = _padded(triples[ids], np.cumsum([0, *[len(docs[i]) for i in at]]))
            x = m.emb[tri].sum(axis=1)
            pooled, where = [], []
            for w in WIDTHS:
                conv = _convolved(m, x, w)
                pos = np.stack([a + conv[a:z].argmax(axis=0) for a, z in zip(begin, end, strict=True)])
                where.append(pos)
                pooled.append(np.take_along_axis(conv, pos, axis=0))
            h = np.concatenate(pooled, axis=1) + m.shift
            a = np.maximum(h, 0)
            z = a @ m.out + m.bias
            g = ((1 / (1 + np.exp(-z)) - y[at]) * weight[at] / len(at)).astype(np.float32)
            back = (g[:, None] * m.out) * (h > 0)
            grads = {"emb": np.zeros_like(m.emb), "shift": back.sum(axis=0), "out": a.T @ g}
            for c, w in enumerate(WIDTHS):
                b, gt = back[:, c * FILTERS : (c + 1) * FILTERS], np.zeros_like(taps[w])
                for j in range(w):
                    tok = where[c] + j
                    gt[j] = np.einsum("nf,nfd->df", b, x[tok])
                    rise = (b[:, :, None] * taps[w][j].T[None]).reshape(-1, DIM)
                    for r in tri[tok].reshape(-1, tri.shape[1]).T:
                        np.add.at(grads["emb"], r, rise)
                grads[f"t{w}"] = gt
            grads["emb"][0] = 0
            m.bias -= 0.05 * float(g.sum())
            for n, p in params.items():
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.99 * second[n] + 0.01 * grads[n] ** 2
                p -= 0.01 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-7)
        if len(check) >= 20:
            z = _all(m, triples, [docs[i] for i in check])
            loss = float((weight[check] * (np.logaddexp(0, z) - y[check] * z)).mean())
            stale = 0 if loss < best else stale + 1
            if loss < best:
                best, kept = loss, ({n: p.copy() for n, p in params.items()}, m.bias)
            if stale >= 5:
                break
    if kept:
        for n, p in params.items():
            p[...] = kept[0][n]
        m.bias = kept[1]
    seen_by = check if len(check) >= 60 and 5 <= y[check].sum() else order
    z = _all(m, triples, [docs[i] for i in seen_by])
    m.threshold = _threshold(z, y[seen_by])
    if language is not None and language.langs:
        lang = np.concatenate([langid.predict(language, [texts[i]])[0] for i in seen_by])
        for i, name in enumerate(language.langs):
            own = lang == i
            n = float(y[seen_by][own].sum())
            if n >= 5 and n < own.sum():  # drawn towards the common threshold while there are few cases
                m.thresholds[name] = m.threshold + n / (n + 20) * (_threshold(z[own], y[seen_by][own]) - m.threshold)
    return m


def _all(m: ToxicityModel, triples: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    out = []
    for part in np.array_split(np.arange(len(docs)), max(1, len(docs) // 64)):
        if len(part):
            x = m.emb[triples[np.concatenate([docs[i] for i in part])]].sum(axis=1)
            out.append(_answers(m, x, np.cumsum([0, *[len(docs[i]) for i in part]])))
    return np.concatenate(out) if out else np.zeros(0)


def scores(m: ToxicityModel, texts: list[bytes]) -> np.ndarray:
    """Calibrated probabilities: 0.5 is the threshold of the text's language."""
    z, lang = raw_scores(m, texts)
    at = np.full(len(texts), m.threshold)
    if m.thresholds and m.language is not None:
        for i, name in enumerate(m.language.langs):
            at[lang == i] = m.thresholds.get(name, m.threshold)
    return 1 / (1 + np.exp(-np.clip(z - at, -50, 50)))


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> ToxicityModel:
    """Trains on about `most` labelled rows (by a hash of the id) outside the held-out fold (on twice as many at
    most where ids repeat, and on about TRAIN_TOTAL bytes); the language model that chooses the thresholds is
    fitted on all of these that tell their language."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isNotNull() & ~held_out("doc_id"))
    chosen = sampled(known, "doc_id", most, known.count()).groupBy("doc_id").agg(F.max("label").alias("label"))  # at most about `most` rows, so they can be broadcast
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    read = read.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= langid.TRAIN_BYTES)
    labelled = read.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "label")
    rows = gathered(labelled, Scratch(docs.sparkSession, "toxicity"), "learnt", 2 * most, TRAIN_TOTAL)
    rows.sort(key=lambda r: (r["doc_id"], r["text"], r["lang"] or ""))
    texts = [r["text"].encode("utf-8", "surrogatepass") for r in rows]
    told = [i for i, r in enumerate(rows) if r["lang"] is not None]
    language = langid.train([texts[i] for i in told], [rows[i]["lang"] for i in told]) if told else None
    return train(texts, np.array([r["label"] for r in rows], np.float32), language)


def _score(m: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scores(m, texts) for _, _, texts in text_slices(b)]
            yield pa.record_batch({"doc_id": b.column(0), "score": pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())})

    return run


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    workers_ready(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = read.mapInArrow(_score(model), f"doc_id {dict(read.dtypes)['doc_id']}, score double")
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
