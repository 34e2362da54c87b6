"""Mixing sources to target shares of all tokens, by pivotal dependent rounding.

Every record of a source is to be used x = share x mix size / source size times on average: floor(x)
copies for all and one more with probability f. The pivotal method settles who gets the one more: two
records with fractional probabilities are paired and probability mass, weighed in tokens, moves from
one to the other (in a random direction that keeps both expectations) until one of them is 0 or 1. The
tokens expected of a pair never change, so a source misses its target by less than one record.

Distributed reduction: records are spread over buckets, a bucket is one pass from large to small records and leaves at
most one unsettled record per source; the rests of FAN buckets meet in the next round, until one per
source is left, which is drawn. Randomness is a hash of (record, round, seed): a task that runs again
decides the same. A source that holds most of the records is spread over all buckets like any other.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrow import slices
from docloom.tables import cut, stage, tokenizer_dir

FAN = 32
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: how these vocabularies split a text before merging (given with them)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_name(col: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(col, r"^\s+|\s+$", "")))


def token_counts(df: DataFrame, key: str, text: str, source: str, vocabulary: str | None = None) -> DataFrame:
    """(rec, source, tokens) of every record of a named source; NULL texts have no tokens; row copies once."""
    path = vocabulary or os.path.join(tokenizer_dir(), VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for b in slices(batches, 512):
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rec"), b.column("source"), pa.array(n, pa.int64())], names=["rec", "source", "tokens"])

    rows = df.where(F.col(key).isNotNull() & F.col(source).isNotNull()).select(F.col(key).cast("bigint").alias("rec"), source_name(F.col(source)).alias("source"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "rec bigint, source string, tokens bigint").groupBy("rec", "source").agg(F.max("tokens").alias("tokens"))


def quotas(counts: DataFrame, targets: DataFrame, mix_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, documents, available, wanted, rate), one row per target source.

    Shares are taken relative to the sources that have tokens. The mix is as large as the scarcest source
    allows at max_repeats, or ``mix_tokens`` if that is less. NULL or negative shares and repeats are 0;
    a source listed twice has its largest share and repeats.
    """
    listed = (
        targets.select(source_name(F.col("source")).alias("source"), F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(0)).alias("max_repeats"))
        .where("source IS NOT NULL")
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    have = counts.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available"))
    q = listed.join(have, "source", "left").na.fill(0, ["documents", "available"])
    usable = (F.col("available") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    total = q.where(usable).agg(F.sum("target_share").alias("shares"), F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")).alias("scale"))
    size = F.col("scale") * F.col("shares")
    if mix_tokens is not None:
        size = F.least(size, F.lit(float(mix_tokens)))
    wanted = F.when(usable, size * F.col("target_share") / F.col("shares")).otherwise(0.0)
    return q.crossJoin(total).withColumn("wanted", wanted).withColumn("rate", F.when(usable, F.least(F.col("wanted") / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0)).drop("shares", "scale")


def _uniform(rec: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = rec.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt & 0xFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def pivotal(rec: np.ndarray, weight: np.ndarray, p: np.ndarray, salt: int) -> np.ndarray:
    """Probabilities after pairing along the order given: all 0 or 1 but one at most; the sum of
    weight x p and each record's expectation stay. Records without weight are drawn on their own."""
    out = p.astype(np.float64).copy()
    u = _uniform(rec, salt)
    held = -1
    for j in range(len(out)):
        if not 0.0 < out[j] < 1.0:
            continue
        if weight[j] <= 0:
            out[j] = float(u[j] < out[j])
            continue
        if held < 0:
            held = j
            continue
        wi, wj, pi, pj = weight[held], weight[j], out[held], out[j]
        up = min(wi * (1 - pi), wj * pj)  # mass that may go to the one held
        down = min(wi * pi, wj * (1 - pj))
        if u[j] * (up + down) < down:
            pi, pj = pi + up / wi, pj - up / wj
        else:
            pi, pj = pi - down / wi, pj + down / wj
        pi, pj = (0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x for x in (pi, pj))
        out[held], out[j] = pi, pj
        held = held if 0.0 < pi < 1.0 else j if 0.0 < pj < 1.0 else -1
    return out


def _settle(units: DataFrame, groups: Column, salt: int, last: bool) -> DataFrame:
    """One round: (rec, source, tokens, p, bucket) with p rounded within each (source, group)."""
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.RecordBatch | None = None  # a group's rows may span batches: only its unsettled row is kept back

        def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal carried
            if carried is not None:
                b = pa.Table.from_batches([carried, b]).combine_chunks().to_batches()[0]
                carried = None
            src, grp = b.column("source").to_pylist(), b.column("grp").to_pylist()
            rec, tok, p = (b.column(c).to_numpy(zero_copy_only=False) for c in ("rec", "tokens", "p"))
            p = p.copy()
            cuts = [0, *(i for i in range(1, len(src)) if (src[i], grp[i]) != (src[i - 1], grp[i - 1])), len(src)]
            for x, y in zip(cuts, cuts[1:]):
                p[x:y] = pivotal(rec[x:y], tok[x:y].astype(np.float64), p[x:y], salt)
            b = b.set_column(b.schema.get_field_index("p"), "p", pa.array(p))
            rest = np.flatnonzero((p > 0) & (p < 1))
            tail = int(rest[-1]) if len(rest) and rest[-1] >= cuts[-2] else None
            if tail is None:
                yield b
            else:
                carried = b.slice(tail, 1)
                yield pa.concat_batches([b.slice(0, tail), b.slice(tail + 1)])

        for b in batches:
            if b.num_rows:
                yield from work(b)
        if carried is not None:
            yield carried

    routed = units.withColumn("grp", groups).repartition(n, "source", "grp").sortWithinPartitions("source", "grp", F.desc("tokens"), "rec")
    done = routed.mapInArrow(run, "rec bigint, source string, tokens bigint, p double, bucket bigint, grp bigint").drop("grp")
    if last:  # one record a source at most: drawn
        draw = F.pmod(F.xxhash64("rec", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        done = done.withColumn("p", F.when((F.col("p") > 0) & (F.col("p") < 1), (draw < F.col("p")).cast("double")).otherwise(F.col("p")))
    return done


def mixture(counts: DataFrame, quota: DataFrame, seed: int = 0) -> DataFrame:
    """(rec, source, tokens, copies) of the records in the mix, copies between 1 and max_repeats."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rates = quota.select("source", "rate", "max_repeats")  # a row per listed source
    x = counts.join(F.broadcast(rates), "source").where("rate > 0")
    whole = F.floor("rate")
    units = cut(x.select("rec", "source", "tokens", whole.cast("int").alias("base"), (F.col("rate") - whole).alias("p"), F.pmod(F.xxhash64("rec", F.lit(seed)), F.lit(n)).alias("bucket")))
    parts, open_, width, level = [], units.select("rec", "source", "tokens", "p", "bucket"), 1, 0
    while True:
        last = width >= n
        done = cut(_settle(open_, F.floor(F.col("bucket") / F.lit(width)).cast("bigint") if not last else F.lit(0).cast("bigint"), seed + level, last))
        parts.append(done.where("p <= 0 OR p >= 1"))
        if last:
            break
        open_, width, level = done.where("p > 0 AND p < 1"), width * FAN, level + 1
    extra = parts[0]
    for q in parts[1:]:
        extra = extra.unionByName(q)
    return (
        units.select("rec", "source", "tokens", "base")
        .join(extra.select("rec", F.col("p").cast("int").alias("one")), "rec")
        .select("rec", "source", "tokens", (F.col("base") + F.col("one")).alias("copies"))
        .where("copies > 0")
    )


def share_report(mix: DataFrame, quota: DataFrame) -> DataFrame:
    """Per listed source: target and reached share, tokens, documents used and the most copies of one."""
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.count(F.lit(1)).alias("used_documents"), F.max("copies").alias("most_copies"))
    rows = quota.join(got, "source", "left").na.fill(0, ["mix_tokens", "used_documents", "most_copies"])
    total = rows.agg(F.greatest(F.sum("mix_tokens"), F.lit(1)).alias("all_tokens"))
    return rows.crossJoin(total).select(
        "source", "target_share", "max_repeats", "documents", "available", "mix_tokens", F.round(F.col("mix_tokens") / F.col("all_tokens"), 6).alias("actual_share"), "used_documents", "most_copies"
    )


def prepared(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", mix_tokens: int | None = None, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(token counts, quotas), both written to the shared folder: texts are tokenised once."""
    counts = stage(token_counts(docs, key, text, source, vocabulary), "tokens")
    return counts, cut(quotas(counts, targets, mix_tokens))
