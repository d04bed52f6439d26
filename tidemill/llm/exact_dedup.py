"""Exact deduplication by content-defined chunk recipes.

A scan cuts each normalised text where a rolling gear hash of its last 16 bytes meets a pattern,
and keeps for each chunk a 64-bit hash and its SHA-256; texts are never shuffled. A chunk's
identifier is its hash, verified over the whole corpus: hashes under which different SHA-256 occur
get one identifier for each of these. Documents are equal when their ordered identifier lists are,
which are grouped and joined by the lists' SHA-256.

Equal means identical after lower-casing A-Z. Null text: as empty. Of equal texts the row with the
largest doc_id stays; rows that repeat this doc_id too all count as kept. Empty table: empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.base import AT, FILE, Scratch, join_groups, keep_or_drop, located, text_slices, without

LEAST, MOST, MASK = 512, 16384, (1 << 11) - 1


def _gear() -> np.ndarray:
    """A 32-bit word for each byte value, by a multiplicative rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(16)).astype(np.uint32)


GEAR = _gear()


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end. Position i depends on the 16 bytes up to i only."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        if len(h) > step:
            nxt = h.copy()
            nxt[step:] += h[:-step] << np.uint32(step)
            h = nxt
    return np.flatnonzero(((h >> np.uint32(16)) & np.uint32(MASK)) == 0) + 1


def chunk_ends(size: int, cuts: np.ndarray) -> list[int]:
    """Ends of the chunks of a text: the first cut after LEAST bytes, MOST bytes at most."""
    ends, at, k = [], 0, 0
    cuts = cuts.tolist()
    while size - at > LEAST:
        while k < len(cuts) and cuts[k] < at + LEAST:
            k += 1
        at = min(cuts[k] if k < len(cuts) else size, at + MOST, size)
        ends.append(at)
    if at < size or not ends:
        ends.append(size)
    return ends


def _recipes(hash_bits: int, extra: tuple[str, ...] = ()):
    keep = (1 << hash_bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, sizes, hashes, shas, per = [], [], [], [], [0]
            for _, _, texts in text_slices(b):
                texts = [t.lower() for t in texts]
                data = np.frombuffer(b"".join(texts), np.uint8)
                cuts, at = cut_points(data), 0
                for t in texts:
                    whole.append(hashlib.sha256(t).hexdigest())
                    sizes.append(len(t))
                    own = cuts[np.searchsorted(cuts, at + LEAST) : np.searchsorted(cuts, at + len(t))] - at if len(t) > LEAST else cuts[:0]
                    lo = 0
                    for hi in chunk_ends(len(t), own):
                        piece = t[lo:hi]
                        hashes.append(xxhash.xxh3_64_intdigest(piece) & keep)
                        shas.append(hashlib.sha256(piece).digest())
                        lo = hi
                    per.append(len(hashes))
                    at += len(t)
            ends = pa.array(per, pa.int32())
            yield pa.record_batch(
                {
                    "doc_id": b.column(0),
                    **{c: b.column(b.schema.get_field_index(c)) for c in extra},
                    "text_sha256": pa.array(whole, pa.string()),
                    "hashes": pa.ListArray.from_arrays(ends, pa.array(np.array(hashes, np.uint64).view(np.int64), pa.int64())),
                    "shas": pa.ListArray.from_arrays(ends, pa.array(shas, pa.binary())),
                }
            )

    return run


def _classes(docs: DataFrame, id_col: str, text_col: str, hash_bits: int, work: Scratch, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_sha256, n_chunks, recipe: a digest of the list of identifiers, and `extra`), and
    classes of equal recipes (recipe, keep_id, group_size, and the row to keep if there are extra columns)."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *extra)
    columns = [f"{c} {dict(read.dtypes)[c]}" for c in ("doc_id", *extra)]
    rows = read.mapInArrow(_recipes(hash_bits, extra), ", ".join([*columns, "text_sha256 string, hashes array<long>, shas array<binary>"]))
    rows = work.save(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "recipes")

    chunks = rows.select("row", F.posexplode(F.arrays_zip("hashes", "shas")).alias("pos", "c")).select("row", "pos", F.col("c.hashes").alias("h"), F.col("c.shas").alias("sha"))
    doubtful = work.save(chunks.groupBy("h").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b").select("h"), "doubtful")
    kept = ["row", "doc_id", *extra, "text_sha256"]
    if doubtful.isEmpty():
        listed = rows.select(*kept, F.transform("hashes", lambda h: F.concat(h.cast("string"), F.lit(":0"))).alias("list"))
    else:
        found = keep_or_drop(chunks.select("h", "sha"), doubtful, ["h"], "left_semi").distinct()
        found = work.save(found.select("h", "sha", F.row_number().over(Window.partitionBy("h").orderBy("sha")).alias("k")), "identifiers")
        lists = chunks.join(found, ["h", "sha"], "left").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "h", F.coalesce("k", F.lit(0)).alias("k")))).alias("c"))
        listed = rows.select(*kept).join(lists.select("row", F.transform("c", lambda c: F.concat(c["h"].cast("string"), F.lit(":"), c["k"].cast("string"))).alias("list")), "row")
    recipe = F.unhex(F.sha2(F.concat_ws(",", "list"), 256))
    listed = work.save(listed.select("doc_id", *extra, "text_sha256", F.size("list").alias("n_chunks"), recipe.alias("recipe")), "listed")
    stays = [F.max(F.struct("doc_id", *extra)).alias("stays")] if extra else []
    return listed, work.save(listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), *stays), "groups")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks for every row of docs.

    hash_bits: shorter chunk hashes, for tests of the verification.
    """
    listed, groups = _classes(docs, id_col, text_col, hash_bits, Scratch(docs.sparkSession, "exact"))
    found = join_groups(listed, groups, "recipe", "group_size")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_chunks")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: one with the largest doc_id, a null one only where all are null.
    Every column as it was; no text is shuffled."""
    work = Scratch(docs.sparkSession, "unique")
    rows = located(docs, work)
    listed, groups = _classes(rows, id_col, text_col, 64, work, (FILE, AT))
    several = groups.where("group_size > 1").select("recipe", "group_size", F.struct(F.col("stays")[FILE], F.col("stays")[AT]).alias("stays"))
    found = join_groups(listed.select("recipe", FILE, AT), work.save(several, "several"), "recipe", "group_size")
    return without(rows, found.where(F.struct(FILE, AT) != F.col("stays")), work)


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
g AS (SELECT doc_id, sha256(low) AS text_sha256, max(doc_id) OVER (PARTITION BY low) AS keep_id, count(*) OVER (PARTITION BY low) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""
