"""Token counts behind a digest cache.

A cache table holds (content digest, tokenizer digest, token count). Documents are reduced to
digests; of each content that the cache lacks one row is encoded and appended, and the counts then come
from the cache by a join. Texts aren't shuffled: the scan that encodes looks up which of its rows to
encode by their places.

Null text: as empty, 0 tokens. Repeated rows: one encoding, a result row each. Empty table: empty.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.base import AT, FILE, Lookup, Scratch, join_groups, located, text_slices, workers_ready

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
_models: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the vocabulary file, so another version never meets the old counts."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _counter(path: str):
    if path not in _models:
        if path.endswith(".model"):
            import sentencepiece

            m = sentencepiece.SentencePieceProcessor(model_file=path)
            _models[path] = lambda texts: [len(x) for x in m.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _models[path] = lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
    return _models[path]


def _encode(path: str, lookup: Lookup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, find = _counter(path), lookup.reader()
        for b in batches:
            rows, found = find(b)
            if found is None:
                continue
            n: list[int] = []
            for _, _, texts in text_slices(b.take(pa.array(rows))):
                n += count([t.decode("utf-8", "replace") for t in texts])
            yield pa.record_batch({"digest": found.column("digest").combine_chunks(), "n_tokens": pa.array(n, pa.int64())})

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cached (the count was there before this call).

    cache_path: a folder all executors reach; made at first use, appended to afterwards.
    """
    spark = docs.sparkSession
    workers_ready(spark)
    work, version = Scratch(spark, "counts"), tokenizer_digest(tokenizer_path)
    content = located(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), work)
    keyed = work.save(content.select("doc_id", FILE, AT, F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "keyed")

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    before = work.save(spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "before")
    groups = work.save(keyed.groupBy("digest").agg(F.min(F.struct(FILE, AT)).alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    lookup = Lookup(groups.join(before, "digest", "left_anti").select(F.col("first")[FILE].alias(FILE), F.col("first")[AT].alias(AT), "digest"), work, "missing")
    if lookup.files:
        counted = lookup.scanned(content.select(FILE, AT, "text")).mapInArrow(_encode(tokenizer_path, lookup), "digest binary, n_tokens long")
        counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    counts = groups.select("digest", "n").join(cache.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "digest")
    counts = work.save(counts.join(before.select("digest", F.lit(True).alias("cached")), "digest", "left"), "counts")
    found = join_groups(keyed.select("doc_id", "digest", "n_bytes"), counts, "digest", "n")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.coalesce("cached", F.lit(False)).alias("cached"))
