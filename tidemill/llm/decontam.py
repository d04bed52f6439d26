"""Benchmark decontamination by template canonicalisation.

Words are canonical when lower-cased and freed of punctuation; numbers, units after numbers and
names (capitalised words) become typed placeholders. A capitalised word that opens a sentence may be a
name or not, so windows with one have two readings, with it as a word and as a name. Windows of eight
canonical words of the documents are joined with those of the benchmark items by hash. The values in the
slots must then agree: along an item's matches, one item value always stands for one document value
(another number or name is fine, a changing one isn't). A document is contaminated by an item when such
windows cover at least half of the item's.

One scan of the documents emits the windows that pass a filter of the benchmark's hashes: a bitmap of
at most FILTER_BITS bits, so its size is bounded, and a larger benchmark only lets more windows through
to the join. Items that differ in the values of their slots only form one class, joined once. Neither
the benchmark nor any document is collected.

Windows with fewer than four literal words are read by their values, so items of numbers are found as
copies, not with other values. An item of four to seven words is one window of all its words; one of
fewer than four is never matched. Null texts: as empty, never matched. Repeated rows: a result row each.
Empty tables: nothing is contaminated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.base import AT, BROADCAST_KEYS, FILE, Scratch, WordTable, flat_words, located, text_slices, without, workers_ready

WINDOW, LITERAL, COVERAGE = 8, 4, 0.5
#: The filter has this many bits at least and at most, and in between 64 for each hash.
LEAST_BITS, FILTER_BITS = 12, 27
# Units that may follow a number.
UNITS = frozenset("mm cm m km in ft mi mg g kg t oz lb lbs ml cl l s sec min h hr hrs hour hours day days week weeks month months year years ms hz khz mhz ghz kb mb gb tb w kw mw v a c f k percent % usd eur gbp dollars euros cents meters metres miles grams liters litres minutes seconds".split())
TRIM = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¿¡«»“”„‘’…–—"
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*%?")
LITERAL_KIND, NUM_KIND, UNIT_KIND, NAME_KIND, NONE_KIND = 0, 1, 2, 3, 4
#: Readings of a window: openers as words, openers as names, all words by their values.
AS_WORDS, AS_NAMES, AS_VALUES = 1, 2, 3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _features(words: list[str]) -> np.ndarray:
    """For each word: hash of its literal form; kind by itself (number, capitalised, a unit's name,
    nothing but punctuation); whether it ends a sentence."""
    out = np.zeros((len(words), 3), np.uint64)
    for i, w in enumerate(words):
        bare = w.strip(TRIM)
        if not bare:
            out[i] = 0, NONE_KIND, any(c in ".!?" for c in w)
            continue
        low = bare.lower()
        kind = NUM_KIND if NUMBER.fullmatch(bare) else UNIT_KIND if low in UNITS else NAME_KIND if len(bare) > 1 and bare[0].isupper() and bare[1:].islower() else LITERAL_KIND
        out[i] = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")), kind, w[-1] in ".!?:|"
    return out


_words = WordTable(_features, alone=True)


def split(text: bytes) -> list[str]:
    return text.decode("utf-8", "replace").split()


@dataclass
class Canonical:
    """Canonical words of several texts: value hash, placeholder kind with openers as words and as
    names, text bounds."""

    value: np.ndarray
    kind: np.ndarray
    named: np.ndarray
    starts: np.ndarray

    def template(self, kind: np.ndarray) -> np.ndarray:
        return np.where(kind == LITERAL_KIND, self.value, kind.astype(np.uint64) * _MIX)


def canonical(texts: list[bytes]) -> Canonical:
    words, starts = flat_words(texts, split)
    if not words:
        z = np.zeros(0, np.uint64)
        return Canonical(z, z.astype(np.uint8), z.astype(np.uint8), np.zeros(len(texts) + 1, np.int64))
    f = _words.of(words)
    value, kind, ends = f[:, 0], f[:, 1].astype(np.uint8), f[:, 2] > 0
    kept = kind != NONE_KIND
    opens = np.concatenate([[True], ends[:-1]])
    opens[starts[:-1][starts[:-1] < len(words)]] = True
    per = np.concatenate([[0], np.cumsum(kept)])[starts]
    value, kind, opens = value[kept], kind[kept], opens[kept]
    named = kind
    if len(value):
        after = np.concatenate([[False], kind[:-1] == NUM_KIND])
        after[per[:-1][per[:-1] < len(value)]] = False
        named = np.where((kind == UNIT_KIND) & ~after, LITERAL_KIND, kind)
        kind = np.where((named == NAME_KIND) & opens, LITERAL_KIND, named)
    return Canonical(value, kind, named, per)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _MIX and of its inverse."""
    if len(_powers[0]) < n:
        _powers[:] = [np.concatenate([[np.uint64(1)], np.full(2 * n, x, np.uint64)]).cumprod(dtype=np.uint64) for x in (_MIX, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def _rolled(words: np.ndarray, size: int, by_value: bool) -> np.ndarray:
    """Hash of every `size` successive words: a polynomial in _MIX, from running sums."""
    up, down = _power(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    h = (total[size:] - total[: len(words) - size + 1]) * down[: len(words) - size + 1]
    h = (h ^ np.uint64(by_value * 64 + size)) * _MIX
    return h ^ (h >> np.uint64(29))


def windows(c: Canonical, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each reading: starts and hashes of the windows of `size` words that lie in one text."""
    n = len(c.value) - size + 1
    if n <= 0:
        return
    ends = np.repeat(c.starts[1:], np.diff(c.starts))
    whole = np.arange(n) + size <= ends[:n]

    def literal(kind: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(kind == LITERAL_KIND)])
        return s[size:] - s[:-size]

    plain, renamed = literal(c.kind), literal(c.named)
    for kind, reading, those in ((c.kind, AS_WORDS, plain >= LITERAL), (c.named, AS_NAMES, (renamed >= LITERAL) & (renamed < plain)), (None, AS_VALUES, plain < LITERAL)):
        at = np.flatnonzero(whole & those)
        if len(at):
            yield at, _rolled(c.value if kind is None else c.template(kind), size, reading == AS_VALUES)[at], reading


@dataclass
class Item:
    """An item's class, the values of its slots, and its windows: hash, start, slot of each word (-1: none)."""

    key: bytes
    slots: list[int]
    size: int
    n: int
    hashes: np.ndarray
    at: np.ndarray
    slot_of: np.ndarray


def item_of(text: bytes) -> Item | None:
    """None for an item of fewer than LITERAL words."""
    c = canonical([text])
    words = len(c.value)
    if words < LITERAL:
        return None
    size = min(WINDOW, words)
    slot = np.full(words, -1, np.int64)
    slots: dict[int, int] = {}
    for i in np.flatnonzero(c.named != LITERAL_KIND):
        slot[i] = slots.setdefault(int(c.value[i]), len(slots))
    hashes, at, slot_of, by_value = [], [], [], False
    for starts, h, reading in windows(c, size):
        pos = starts[:, None] + np.arange(size)
        own = np.full((len(starts), WINDOW), -1, np.int64)
        own[:, :size] = -1 if reading == AS_VALUES else np.where((c.kind if reading == AS_WORDS else c.named)[pos] == LITERAL_KIND, -1, slot[pos])
        by_value |= reading == AS_VALUES
        hashes.append(h)
        at.append(starts)
        slot_of.append(own)
    parts = [c.template(c.kind), c.template(c.named), slot, c.value if by_value else slot[:0]]
    key = xxhash.xxh3_128_digest(b"".join(np.ascontiguousarray(x).tobytes() for x in parts))
    return Item(key, [int(np.uint64(v).view(np.int64)) for v in slots], size, words - size + 1, np.concatenate(hashes), np.concatenate(at), np.concatenate(slot_of).astype("<i4"))


ITEM_COLUMNS = "item_id long, class binary, slots array<long>, size int, n long, windows array<struct<h: long, q: long, slot_of: binary>>"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for lo, _, texts in text_slices(b):
            for k, t in enumerate(texts):
                if m := item_of(t):
                    own = [{"h": h, "q": q, "slot_of": s.tobytes()} for h, q, s in zip(m.hashes.view(np.int64).tolist(), m.at.tolist(), m.slot_of, strict=True)]
                    rows.append((lo + k, m, own))
        ids = b.column(0).take(pa.array([i for i, _, _ in rows], pa.int64())).cast(pa.int64())
        kind = pa.list_(pa.struct([("h", pa.int64()), ("q", pa.int64()), ("slot_of", pa.binary())]))
        yield pa.record_batch({"item_id": ids, "class": pa.array([m.key for _, m, _ in rows], pa.binary()), "slots": pa.array([m.slots for _, m, _ in rows], pa.list_(pa.int64())), "size": pa.array([m.size for _, m, _ in rows], pa.int32()), "n": pa.array([m.n for _, m, _ in rows], pa.int64()), "windows": pa.array([w for *_, w in rows], kind)})


class HashFilter:
    """A bitmap with two bits for each hash: tells hashes that may be there from those that aren't."""

    def __init__(self, bits: int, words: np.ndarray, values: np.ndarray) -> None:
        self.bits = bits
        self.map = np.zeros(1 << (bits - 6), np.int64)
        self.map[words] = values

    @classmethod
    def of(cls, hashes: DataFrame) -> HashFilter:
        """hashes: a column h. Sent to the driver: at most 2^(FILTER_BITS - 6) words of 64 bits."""
        bits = int(np.clip(np.ceil(np.log2(64 * max(1, hashes.count()))), LEAST_BITS, FILTER_BITS))
        places = F.explode(F.array(F.shiftrightunsigned("h", 64 - bits), F.shiftrightunsigned("h", 64 - 2 * bits).bitwiseAND((1 << bits) - 1)))
        words = hashes.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("v")).toArrow()
        return cls(bits, words.column("w").to_numpy(), words.column("v").to_numpy())

    def may_have(self, h: np.ndarray) -> np.ndarray:
        """Positions in h."""
        at = np.arange(len(h))
        for shift in (64 - self.bits, 64 - 2 * self.bits):
            p = (h[at] >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            at = at[(self.map[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)).astype(np.int64)) & 1 > 0]
        return at


FOUND_COLUMNS = "h long, pos long, value binary"


def _emit(sizes: list[int], held, id_type: str):
    """Windows of the documents that the filter lets through, with the values of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, hashes, pos, value = [], [], [], []
            for lo, _, texts in text_slices(b):
                c = canonical(texts)
                padded = np.concatenate([c.value, np.zeros(WINDOW, np.uint64)])
                for size in sizes:
                    for at, h, _ in windows(c, size):
                        hit = held.value.may_have(h)
                        if not len(hit):
                            continue
                        at = at[hit]
                        text = np.searchsorted(c.starts, at, side="right") - 1
                        row.append(lo + text)
                        pos.append(at - c.starts[text])
                        hashes.append(h[hit])
                        value.append(padded[at[:, None] + np.arange(WINDOW)])
            if not row:
                continue
            own, n = pa.array(np.concatenate(row)), sum(map(len, row))
            raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (8 * WINDOW)), pa.py_buffer(np.concatenate(value).tobytes())])
            yield pa.record_batch({**{x: b.column(b.schema.get_field_index(x)).take(own) for x in ("doc_id", FILE, AT)}, "h": pa.array(np.concatenate(hashes).view(np.int64)), "pos": pa.array(np.concatenate(pos)), "value": raw})

    return run


def agreeing(slot_of: np.ndarray, value: np.ndarray, q: np.ndarray) -> tuple[int, dict[int, int]]:
    """How many of an item's windows agree with the commonest reading of its slots (ties: the smallest
    value), and this reading. A row for each pair of an item's and a document's window."""
    in_slot = slot_of >= 0
    if not in_slot.any():
        return len(np.unique(q)), {}
    pairs, votes = np.unique(np.stack([slot_of[in_slot], value[in_slot]], axis=1), axis=0, return_counts=True)
    best = pairs[np.lexsort((-votes, pairs[:, 0]))]
    slots, first = np.unique(best[:, 0], return_index=True)
    reading = np.zeros(int(slots[-1]) + 1, np.int64)
    reading[slots] = best[first, 1]
    good = ((reading[np.maximum(slot_of, 0)] == value) | ~in_slot).all(axis=1)
    return len(np.unique(q[good])), dict(zip(slots.tolist(), reading[slots].tolist(), strict=True))


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches sorted by document and class -> the classes that cover enough."""
    held: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(b.schema.get_field_index(c))[i].as_py() for c in (FILE, AT, "class"))

    def judged() -> dict | None:
        rows = pa.Table.from_batches(held)
        n = rows.column("n")[0].as_py()
        q = rows.column("q").to_numpy()
        if len(np.unique(q)) < COVERAGE * n:
            return None
        slot_of = np.frombuffer(b"".join(rows.column("slot_of").to_pylist()), "<i4").reshape(-1, WINDOW).astype(np.int64)
        value = np.frombuffer(b"".join(rows.column("value").to_pylist()), "<i8").reshape(-1, WINDOW)
        agree, reading = agreeing(slot_of, value, q)
        if agree < COVERAGE * n:
            return None
        return {**{c: rows.column(c)[0].as_py() for c in ("doc_id", FILE, AT, "class")}, "n_matched": agree, "n_windows": n, "slot": list(reading), "means": list(reading.values())}

    def told(out: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        kinds = [(c, schema.field(c).type) for c in ("doc_id", FILE, AT, "class")]
        return pa.RecordBatch.from_pylist(out, pa.schema([*kinds, ("n_matched", pa.int64()), ("n_windows", pa.int64()), ("slot", pa.list_(pa.int64())), ("means", pa.list_(pa.int64()))]))

    for b in batches:
        out = []
        file, at, cls = (b.column(b.schema.get_field_index(c)) for c in (FILE, AT, "class"))
        codes = cls.dictionary_encode().indices.to_numpy()
        new = np.flatnonzero((np.diff(file.to_numpy()) != 0) | (np.diff(at.to_numpy()) != 0) | (np.diff(codes) != 0)) + 1
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), b.num_rows], strict=True):
            if hi > lo:
                if held and key(held[0], 0) != key(b, lo):
                    out.append(judged())
                    held = []
                held.append(b.slice(lo, hi - lo))
        yield told([x for x in out if x], b.schema)
    if held and (last := judged()):
        yield told([last], held[0].schema)


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, work: Scratch, most: int) -> tuple[DataFrame, DataFrame]:
    """Documents and the classes that cover them (doc_id, FILE, AT, class, n_matched, n_windows, slot,
    means), and the items (item_id, class, slots). docs has FILE and AT."""
    read = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("text is not null")
    items = work.save(read.mapInArrow(_items, ITEM_COLUMNS), "items")
    classes = items.groupBy("class").agg(F.first("size").alias("size"), F.first("n").alias("n"), F.first("windows").alias("windows"))
    theirs = work.save(classes.select("class", "size", "n", F.explode("windows").alias("w")).select("w.h", "class", "n", "w.q", "w.slot_of", "size"), "windows")
    sizes = sorted(r["size"] for r in theirs.select("size").distinct().collect())  # WINDOW - LITERAL + 1 at most
    held = work.spark.sparkContext.broadcast(HashFilter.of(theirs.select("h").distinct()))
    own = docs.select(F.col(id_col).alias("doc_id"), FILE, AT, F.col(text_col).alias("text"))
    id_type = dict(own.dtypes)["doc_id"]
    ours = work.save(own.mapInArrow(_emit(sizes, held, id_type), f"doc_id {id_type}, {FILE} long, {AT} long, {FOUND_COLUMNS}"), "passed")
    held.unpersist()
    theirs = theirs.drop("size")
    matches = ours.join(F.broadcast(theirs) if theirs.count() <= most else theirs.hint("merge"), "h").select("doc_id", FILE, AT, "class", "n", "q", "pos", "slot_of", "value")
    placed = matches.repartition(FILE, AT).sortWithinPartitions(FILE, AT, "class", "q", "pos")
    return placed.mapInArrow(_check, f"doc_id {id_type}, {FILE} long, {AT} long, class binary, n_matched long, n_windows long, slot array<long>, means array<long>"), items.select("item_id", "class", "slots")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, slots_changed, coverage for each document and item
    whose windows are covered. most: windows of the benchmark up to which these are broadcast to the join."""
    workers_ready(docs.sparkSession)
    work = Scratch(docs.sparkSession, "decontam")
    found, items = _found(located(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work), benchmark, "doc_id", "text", work, most)
    pairs = work.save(found, "found").join(items, "class")
    changed = F.exists(F.arrays_zip("slot", "means"), lambda s: F.get("slots", s["slot"].cast("int")) != s["means"])
    return pairs.select("doc_id", "item_id", "n_matched", "n_windows", changed.alias("slots_changed"), F.round(F.col("n_matched") / F.col("n_windows"), 4).alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_KEYS) -> DataFrame:
    """docs without the contaminated rows; every column as it was, no text is shuffled."""
    workers_ready(docs.sparkSession)
    work = Scratch(docs.sparkSession, "clean")
    places = located(docs, work)
    found, _ = _found(places, benchmark, id_col, text_col, work, most)
    return without(places, found.select(FILE, AT).distinct(), work)
