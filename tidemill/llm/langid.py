"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by
stochastic gradient descent in numpy, with a calibrated temperature and rejection threshold.

A text's vector is the mean over all character 2- to 4-grams of its lower-cased, bracketed words.
After training, embedding and softmax fold into one table of scores for each bucket, so a word's
scores are looked up once a worker.

Besides the languages there is a class for what is none, learnt from junk that is made of the training
texts: their letters in another order, letters drawn evenly, and strings of letters and digits. The
score is the best language's probability beside all of these. The rejection threshold is the highest
that loses at most LOST of calibration texts that were never trained on: whole ones that were told
rightly, their first words, and pairs of texts in two languages, which are no junk either.

Null texts and texts without a letter: `und`, score 0, rejected. Repeated rows: a result row each.
Empty table: empty. Without any labelled row nothing can be learnt, and every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.base import Scratch, WordTable, flat_words, gathered, held_out, sampled, segment_sum, text_slices, workers_ready

BUCKETS, DIM = 1 << 15, 16
GRAMS = (2, 3, 4)
#: Most labelled documents that training reads, about, the longest of them in bytes, and all of them together.
TRAIN_DOCS, TRAIN_BYTES, TRAIN_TOTAL = 1500, 1 << 18, 16 << 20
#: The share of calibration texts that the rejection threshold may cost, and the lengths in words to which these are cut.
LOST, CUTS = 0.001, (4, 8, 16)
UNKNOWN = "und"


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # buckets x (langs and none), score of a subword
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    junk_rejected: float = 0.0  # share of calibration junk that the threshold rejects
    key: str = ""


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, word after word, and where each word's begin."""
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # code points to the word's end
    grams, valid = [], []
    for n in GRAMS:
        h = np.full(len(code), n, np.uint64)
        for k in range(n):
            h = (h ^ np.concatenate([code[k:], np.zeros(min(k, len(code)), np.uint64)])) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(31)
        grams.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15))
        valid.append(left >= n)
    ok = np.stack(valid, axis=1)
    flat = np.stack(grams, axis=1).astype(np.int64)[ok]
    per = segment_sum(ok.sum(axis=1), np.concatenate([[0], np.cumsum(size)]))
    return flat, np.concatenate([[0], np.cumsum(per)])


def split(text: bytes) -> list[str]:
    return text.decode("utf-8", "replace").lower().split()


def junk(texts: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """A text of no language for each text, as long as it and with words as long."""
    out = []
    for k, t in enumerate(texts):
        words = split(t)[:400]
        sizes = np.array([len(w) for w in words], int)
        if k % 3 == 0:
            letters = rng.permutation(list("".join(words))) if words else np.zeros(0, str)
        elif k % 3 == 1:
            letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), sizes.sum())
        else:
            sizes = sizes * 4
            letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), sizes.sum())
        cuts = np.cumsum(sizes)
        out.append(" ".join("".join(letters[z - n : z]) for n, z in zip(sizes.tolist(), cuts.tolist(), strict=True)).encode())
    return out


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct subwords of a text and their shares."""
    flat, _ = subwords(split(text)) if text.strip() else (np.zeros(0, np.int64), None)
    b, n = np.unique(flat, return_counts=True)
    return b, (n / max(1, n.sum())).astype(np.float32)


def train(texts: list[bytes], labels: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """texts and labels in any order; a fifth of them calibrates."""
    langs = sorted(set(labels))
    none, rng = len(langs), np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    n_check = len(order) // 5 if len(order) >= 100 else 0
    made = rng.permutation(order)[: max(1, len(order) // (none + 1))].tolist()
    false = junk([texts[i] for i in made], rng)
    y = np.array([*[langs.index(x) for x in labels], *[none] * len(false)])
    rows = [_bag(t) for t in [*texts, *false]]
    check = set(order[:n_check].tolist())
    check |= {len(texts) + k for k, i in enumerate(made) if i in check}
    fit = np.array([i for i in range(len(rows)) if i not in check and len(rows[i][0])], np.int64)
    emb = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, none + 1), np.float32), np.zeros(none + 1, np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    share = np.bincount(y, minlength=none + 1) / max(1, len(y))
    weight = np.clip(1 / np.maximum(share * (none + 1), 1e-6), 0.5, 3.0)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 16)):
            if not len(at):
                continue
            idx, val = np.concatenate([rows[i][0] for i in at]), np.concatenate([rows[i][1] for i in at])
            starts = np.cumsum([0, *[len(rows[i][0]) for i in at]])
            h = segment_sum(emb[idx] * val[:, None], starts)
            p = softmax(h @ out + bias)
            p[np.arange(len(at)), y[at]] -= 1
            p *= weight[y[at]][:, None]
            back = p @ out.T
            out -= step * h.T @ p / len(at) * 4
            bias -= step * p.mean(axis=0)
            np.add.at(emb, idx, -step * 20 * val[:, None] * np.repeat(back, np.diff(starts), axis=0))
    model = LanguageModel(langs, (emb @ out).astype(np.float32), bias)
    _calibrate(model, texts, rows, y, sorted(check) or range(len(rows)), rng)
    model.key = f"{hash(model.table.tobytes())}"
    return model


def _calibrate(model: LanguageModel, texts: list[bytes], rows: list, y: np.ndarray, check, rng: np.random.Generator) -> None:
    """Sets temperature and threshold from the calibration texts (numbers in `check`)."""
    def mean(bag) -> np.ndarray:
        return (model.table[bag[0]] * bag[1][:, None]).sum(axis=0)

    seen = [i for i in check if len(rows[i][0])]
    if not seen:
        return
    none = len(model.langs)
    bags, told = [rows[i] for i in seen], [int(y[i]) for i in seen]
    for i in seen:
        if y[i] < none:  # its first words, by which a language is harder to tell
            words = texts[i].split()
            bags += [_bag(b" ".join(words[:n])) for n in CUTS if n < len(words)]
            told += [int(y[i])] * (len(bags) - len(told))
    full = [k for k, b in enumerate(bags) if len(b[0])]
    z, right = np.stack([mean(bags[k]) for k in full]), np.array([told[k] for k in full])

    def loss(t: float) -> float:
        p = softmax((z + model.bias) * t)
        return float(-np.log(np.maximum(p[np.arange(len(z)), right], 1e-30)).mean())

    model.temperature = min((0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0), key=loss)
    score = lambda z: softmax((z + model.bias) * model.temperature)[:, :none]
    text = np.flatnonzero(right < none)
    p = score(z[text])
    kept = p.max(axis=1)[p.argmax(axis=1) == right[text]]
    whole = text[text < len(seen)]
    a, b = rng.permutation(whole), rng.permutation(whole)
    mixed = right[a] != right[b]
    if mixed.any():
        kept = np.concatenate([kept, score((z[a][mixed] + z[b][mixed]) / 2).max(axis=1)])
    if len(kept):
        model.threshold = float(np.quantile(kept, LOST))
    false = score(z[right == none])
    model.junk_rejected = float((false.max(axis=1, initial=0) < model.threshold).mean()) if len(false) else 0.0


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


_tables: dict[str, WordTable] = {}


def word_features(model: LanguageModel, words: list[str]) -> np.ndarray:
    """A word's summed scores, how many subwords it has, whether it has a letter."""
    flat, starts = subwords(words)
    out = np.zeros((len(words), len(model.langs) + 3), np.float32)
    out[:, :-2] = segment_sum(model.table[flat], starts)
    out[:, -2] = np.diff(starts)
    out[:, -1] = [w.isalpha() or any(map(str.isalpha, w)) for w in words]
    return out


def answers(model: LanguageModel, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts, from the sums of their words' features: index of the language (-1: und), its
    probability, and whether the answer is rejected."""
    if not model.langs:
        return np.full(len(sums), -1), np.zeros(len(sums)), np.ones(len(sums), bool)
    p = softmax((sums[:, :-2] / np.maximum(sums[:, -2:-1], 1) + model.bias) * model.temperature)[:, :-1]
    none = sums[:, -1] == 0
    best, score = np.where(none, -1, p.argmax(axis=1)), np.where(none, 0.0, p.max(axis=1))
    return best, score, none | (score < model.threshold)


def _table(model: LanguageModel) -> WordTable:
    """The worker's table for this model."""
    if model.key not in _tables:
        _tables.clear()
        _tables[model.key] = WordTable(lambda words: word_features(model, words))
    return _tables[model.key]


def predict(model: LanguageModel, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """answers() of whole texts."""
    words, starts = flat_words(texts, split)
    sums = np.zeros((len(texts), len(model.langs) + 3))
    if words and model.langs:
        table = _table(model)
        ids = table.ids(words)
        sums = segment_sum(table.rows[ids].astype(np.float64), starts)
    return answers(model, sums)


def learn(docs: DataFrame, most: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Trains on about `most` rows (by a hash of the id) outside the held-out fold; on twice as many at most
    where ids repeat, and on about TRAIN_TOTAL bytes."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = read.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= TRAIN_BYTES) & ~held_out("doc_id"))
    total = known.select("doc_id").count()
    work = Scratch(docs.sparkSession, "language")
    rows = gathered(sampled(known, "doc_id", most, total).select("doc_id", "text", "lang"), work, "learnt", 2 * most, TRAIN_TOTAL)
    rows.sort(key=lambda r: (r["doc_id"], r["text"], r["lang"]))
    if not rows:
        return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32))
    return train([r["text"].encode("utf-8", "surrogatepass") for r in rows], [r["lang"] for r in rows])


def _identify(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNKNOWN], object)
        for b in batches:
            got = [predict(model, texts) for _, _, texts in text_slices(b)]
            best, score, bad = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
            yield pa.record_batch({"doc_id": b.column(0), "lang_pred": pa.array(names[best], pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(bad)})

    return run


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    workers_ready(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = read.mapInArrow(_identify(model), f"doc_id {dict(read.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; every column as it was, no shuffle."""
    workers_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = [predict(model, texts)[2] for _, _, texts in text_slices(b, text_col)]
            yield b.filter(pa.array(~np.concatenate(bad))) if bad else b

    return docs.mapInArrow(run, docs.schema)
