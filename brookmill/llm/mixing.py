"""Mixing sources to target weights: weighted sampling by exponential keys, whole epochs first, sizes in tokens."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookmill.session import SharedTable

#: Where a vocabulary of a public byte-level tokenizer lies, in tiktoken's format; parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How that family of tokenizers cuts a text before merging. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sampling keys are put in this many places an octave. Keys of records of one weight w are exponential with rate w, so
#: whatever w is no place has over ln(2) / e / PLACES of them, a thousandth; records of other weights only spread more.
PLACES = 256
#: Least weight of a record, so that none is out of reach.
LEAST_QUALITY = 0.05


@lru_cache(maxsize=2)
def encoding(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def quality_of(tokens: np.ndarray, letters: float) -> float:
    """A weight in [LEAST_QUALITY, 1] from what a text repeats and consists of, the same in all languages.

    The product of the share of its runs of four tokens that are new, its distinct tokens against those that running
    text of its length has at least (half of n ** 0.8), and its share of ``letters`` and digits; halved under 20 tokens.
    """
    n = len(tokens)
    if not n:
        return LEAST_QUALITY
    fresh = 1.0
    if n > 4:
        t = tokens.astype(np.uint64)
        runs = t[:-3]
        for k in range(1, 4):
            runs = runs * np.uint64(1_000_003) + t[k : n - 3 + k]
        fresh = len(np.unique(runs)) / len(runs)
    variety = min(1.0, len(np.unique(tokens)) / (0.5 * n**0.8))
    return max(LEAST_QUALITY, fresh * variety * letters * (0.5 if n < 20 else 1.0))


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep``, ``n_tokens``, the tokens of the whole text, and its ``quality``; a null or empty text has 0 tokens."""
    schema = documents.select(*keep).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            size = pc.utf8_length(texts).to_pylist()
            left = pc.utf8_length(pc.replace_substring_regex(texts, r"[^\p{L}\p{M}\p{N}]+", "")).to_pylist()
            n, q = [], []
            for t, a, b in zip(texts.to_pylist(), left, size):
                ids = np.array(enc.encode_ordinary(t) if t else [], dtype=np.int64)
                n.append(len(ids))
                q.append(quality_of(ids, a / b if b else 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(q, pa.float64())], names=[*keep, "n_tokens", "quality"])

    return documents.select(*keep, F.col(text).alias("_text")).mapInArrow(count, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", n_tokens bigint, quality double")


def allot(available: dict[str, int], targets: list[tuple[str, float, int]], total: float) -> dict[str, float]:
    """Tokens of each target source so that shares of ``total`` are met as nearly as the repeats allow.

    A source gives at most max_repeats times what it has; what one can't give is spread over the others by their shares.
    """
    given = {s: 0.0 for s, _, _ in targets}
    most = {s: float(available.get(s, 0)) * max(0, r or 0) for s, _, r in targets}
    open_ = {s: w for s, w, _ in targets if w and w > 0 and most[s] > 0}
    left = total
    while open_ and left > 1e-9:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if left * w / weight >= most[s]]
        if not full:
            for s, w in open_.items():
                given[s] = left * w / weight
            break
        for s in full:
            given[s] = most[s]
            del open_[s]
        left = total - sum(given.values())
    return given


def largest_total(available: dict[str, int], targets: list[tuple[str, float, int]]) -> float:
    """The largest size at which every target source that has anything meets its share within its repeats."""
    able = [(w, available[s] * r) for s, w, r in targets if w and w > 0 and available.get(s, 0) * (r or 0) > 0]
    return min((most * sum(w for w, _ in able) / w for w, most in able), default=0.0)


def mix_sources(
    documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
    total_tokens: int | None = None, weight: Column | None = None, seed: int = 11, vocabulary: str = VOCABULARY, places: int = PLACES,
) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the records of the mix, each with how often it is taken.

    ``targets``: source, target_share, max_repeats. ``total_tokens`` defaults to the largest size
    at which all sources that have any records meet their shares (largest_total); a larger one makes sources run out.
    A source's budget (allot) is met by whole epochs of all its records and then by a sample of what is missing: records
    in ascending order of -ln(u) / weight, u a hash of the id and ``seed``, which is Efraimidis and Spirakis' sampling
    without replacement, as long as the sum of tokens before and half of the record itself is within the missing part.
    A source thus misses its budget by at most half a record. ``weight`` is quality_of without one given. The order is
    over a whole source, found without sorting it: tokens are summed up by place of the key, and only the records of the
    one place in which the missing part ends are sorted; all others lie wholly before or after it. Records without a
    text or with a source that is no target stay out; ties go by id.
    """
    goals = [(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.where("source is not null").collect()]
    if len(goals) > 10_000:
        raise ValueError("more than 10000 target sources")
    rows = documents.withColumn("_weight", weight.cast("double") if weight is not None else F.lit(None).cast("double")).where(F.col(source).isin([g[0] for g in goals]) & F.col(text).isNotNull())
    counted = token_counts(rows, [doc_id, source, "_weight"], text, vocabulary).where("n_tokens > 0")
    w = F.greatest(F.col("_weight") if weight is not None else F.col("quality"), F.lit(1e-6))
    u = (F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float((1 << 52) - 1))
    key = -F.ln(u) / w
    kept = counted.select(F.col(doc_id).alias("_id"), F.col(source).alias("_source"), "n_tokens", key.alias("_key")).withColumn("_place", place_of(F.col("_key"), places))
    kept = SharedTable(kept, "mix").read()
    per_place = SharedTable(kept.groupBy("_source", "_place").agg(F.sum("n_tokens").alias("_t")), "places").read()
    available = {r["_source"]: r["t"] for r in per_place.groupBy("_source").agg(F.sum("_t").alias("t")).collect()}
    total = total_tokens if total_tokens is not None else largest_total(available, goals)
    given = allot(available, goals, total)
    plan = [(s, int(g // available[s]), g - available[s] * int(g // available[s])) for s, g in given.items() if available.get(s)]
    plans = documents.sparkSession.createDataFrame(plan, "_source string, _epochs int, _missing double")
    through = F.sum("_t").over(W.partitionBy("_source").orderBy("_place").rowsBetween(W.unboundedPreceding, 0))
    ends = per_place.withColumn("_through", through).join(F.broadcast(plans), "_source").where((F.col("_through") > F.col("_missing")) & (F.col("_through") - F.col("_t") <= F.col("_missing")))
    # one row a source, and there are at most 10000
    ends = ends.select("_source", "_epochs", "_missing", F.col("_place").alias("_end"), (F.col("_through") - F.col("_t")).alias("_before"))
    placed = kept.join(F.broadcast(ends), "_source")
    whole = placed.where("_place <> _end").withColumn("copies", F.col("_epochs") + (F.col("_place") < F.col("_end")).cast("int"))
    order = W.partitionBy("_source").orderBy("_key", "_id").rowsBetween(W.unboundedPreceding, -1)
    at_end = placed.where("_place = _end").withColumn("_sum", F.col("_before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    at_end = at_end.withColumn("copies", F.col("_epochs") + (F.col("_sum") + F.col("n_tokens") / 2 <= F.col("_missing")).cast("int"))
    cols = ["_id", "_source", "n_tokens", "copies"]
    return whole.select(cols).unionByName(at_end.select(cols)).where("copies > 0").select(F.col("_id").alias(doc_id), F.col("_source").alias(source), "n_tokens", "copies")


def place_of(key: Column, places: int = PLACES) -> Column:
    return F.floor(F.log2(key) * places).cast("int")


def mix_report(mixed: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """Per target source its tokens in the mix, their actual share beside the target, records and the most copies of one.

    The window over all rows has one row a target.
    """
    per = mixed.groupBy(source).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_records"), F.max("copies").alias("most_copies"))
    joined = targets.join(per, source, "left").na.fill(0, ["tokens", "n_records", "most_copies"])
    return joined.withColumn("share", F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(W.partitionBy(F.lit(1)))))
