"""Lexical and vector retrieval over a batch of questions, and rank fusion."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import DIM, hash_tokens, token_bucket, token_sign
from docloom.tables import stage

QUESTION_BLOCK = 2048


def topk(df: DataFrame, k: int, by: str, score: str, tie: str, rank: str = "rank") -> DataFrame:
    """The k best rows of each group with a total order; the limit is applied before the shuffle too."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


# Lexical


def build_lexical_index(chunks: DataFrame, key: str, text: str, staged: bool = False, postings_too: bool = True) -> dict[str, DataFrame]:
    """tokens(chunk_id, t), postings(term, chunk_id, tf), doc_len(chunk_id, dl), term_df(term, df) and one row of
    stats(n, avgdl).

    ``staged``: tokens, and postings if asked for, are written to the shared folder, so texts are tokenised once.
    """
    tokens = chunks.where(F.col(key).isNotNull()).select(F.col(key).alias("chunk_id"), hash_tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")).groupBy("chunk_id").agg(F.min("t").alias("t"))
    if staged:
        tokens = stage(tokens, "tokens")
    postings = tokens.select("chunk_id", F.explode("t").alias("term")).groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))
    if staged and postings_too:
        postings = stage(postings, "postings")
    return _index_of(tokens, postings)


def _index_of(tokens: DataFrame, postings: DataFrame) -> dict[str, DataFrame]:
    doc_len = tokens.select("chunk_id", F.size("t").alias("dl"))
    return {
        "tokens": tokens,
        "postings": postings,
        "doc_len": doc_len,
        "term_df": postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")),
        "stats": doc_len.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")),
    }


def write_index(chunks: DataFrame, key: str, text: str, folder: str, mode: str = "overwrite") -> None:
    """The tokens of each chunk and its unit vector by chunk_id, and the chunks themselves, as tables of ``folder``:
    an index that other sessions read by name. ``mode``: overwrite, or append further chunks."""
    rows = chunks.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("chunk_id")).agg(F.min(F.col(text)).alias("content"))
    rows.write.mode(mode).parquet(f"{folder}/chunks")
    stored = rows.sparkSession.read.parquet(f"{folder}/chunks") if mode == "overwrite" else rows
    stored.select("chunk_id", hash_tokens(F.coalesce("content", F.lit(""))).alias("t")).write.mode(mode).parquet(f"{folder}/tokens")
    hash_embed(stored.where("content IS NOT NULL"), "chunk_id", "content").write.mode(mode).parquet(f"{folder}/vectors")


def open_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a written index; the lexical ones are left out if their files are missing, so that a search goes by
    vectors alone."""
    out = {name: spark.read.parquet(f"{folder}/{name}") for name in ("chunks", "vectors")}
    try:
        tokens = spark.read.parquet(f"{folder}/tokens")
    except AnalysisException:
        return out
    return out | _index_of(tokens, tokens.select("chunk_id", F.explode("t").alias("term")).groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf")))


class _Asked:
    """A block of questions as a matrix of terms by questions."""

    def __init__(self, rows: list[tuple[int, list[str]]]) -> None:
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.terms = pa.array(sorted({t for _, ts in rows for t in ts}), pa.string())
        at = {t: j for j, t in enumerate(self.terms.to_pylist())}
        self.times = np.zeros((len(at), len(rows)))
        for q, (_, ts) in enumerate(rows):
            for t in ts:
                self.times[at[t], q] += 1

    def counted(self, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, times) of the asked terms in each row, sorted by row."""
        where = pc.index_in(tokens.flatten(), value_set=self.terms)
        known = pc.is_valid(where).to_numpy(zero_copy_only=False)
        row = pc.list_parent_indices(tokens).to_numpy()[known].astype(np.int64)
        key, n = np.unique(row * max(1, len(self.terms)) + where.drop_null().to_numpy(), return_counts=True)
        return key // max(1, len(self.terms)), key % max(1, len(self.terms)), n


def bm25_topk(questions: DataFrame, index: dict[str, DataFrame], k: int = 50, k1: float = 1.5, b: float = 0.75, delta: float = 1.0, where: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(question_id, chunk_id, score, rank) by BM25+ with idf = ln((n + 1) / df).

    The questions are a stated set, taken in blocks of QUESTION_BLOCK: a block's terms go to the tasks, which count
    them in their own chunks and score all questions with one product of matrices; only the k best of each task are
    merged, no posting is shuffled. ``where``: chunk ids to keep, applied before the ranking. A term that a question
    has twice counts twice. ``delta`` counts for every known term of the question, matched or not, so it is a constant
    of the question. Chunks without any of the terms are not returned, unless ``strict``: then they follow with the
    constant alone, least ids first, up to k.
    """
    tokens = index["tokens"]
    asked = [(r[0], r[1]) for r in questions.where("question_id IS NOT NULL").select("question_id", hash_tokens(F.coalesce("question", F.lit("")))).distinct().toLocalIterator()]
    n, avgdl = index["stats"].first() or (0, 0.0)
    kept = tokens if where is None else tokens.join(where.select("chunk_id").distinct(), "chunk_id", "left_semi")
    parts = []
    for at in range(0, max(1, len(asked)), QUESTION_BLOCK):
        block = _Asked(asked[at : at + QUESTION_BLOCK])

        def count(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(block.terms), np.int64)
            for batch in batches:
                _, term, _ = block.counted(batch.column("t"))
                df += np.bincount(term, minlength=len(df))
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

        df = np.zeros(len(block.terms))
        for r in tokens.select("t").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most the block's terms
            df[r["term"]] = r["df"]
        idf = np.where(df > 0, np.log((n + 1) / np.maximum(df, 1)), 0.0)
        weight = block.times * idf[:, None]
        base = weight.sum(axis=0) * delta

        def score(batches: Iterator[pa.RecordBatch], block=block, weight=weight, base=base) -> Iterator[pa.RecordBatch]:
            best = _Best(block.ids, k)
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    row, term, tf = block.counted(part.column("t"))
                    dl = pc.list_value_length(part.column("t")).to_numpy(zero_copy_only=False)
                    dense = np.zeros((part.num_rows, len(block.terms)))
                    dense[row, term] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
                    has = np.zeros(dense.shape, np.float32)
                    has[row, term] = 1
                    used = np.unique(term)
                    s = np.round(dense[:, used] @ weight[used] + base, 4)
                    s[(has[:, used] @ (block.times[used] > 0).astype(np.float32)) == 0] = -np.inf
                    best.add(part.column("chunk_id").to_numpy(), s.T)
            yield best.batch("chunk_id")

        kind = "question_id bigint, chunk_id bigint, score double"
        parts.append(kept.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "t").mapInArrow(score, kind))
        if strict:
            parts.append(_unmatched(questions.sparkSession, kept, parts[-1], block.ids, np.round(base, 4), k))
    return topk(reduce(DataFrame.unionByName, parts), k, "question_id", "score", "chunk_id")


def _unmatched(spark: SparkSession, chunks: DataFrame, scored: DataFrame, ids: np.ndarray, base: np.ndarray, k: int) -> DataFrame:
    """Chunks that share no term with a question, for questions with less than k others: among the 2k least ids are
    k of them at least."""
    few = F.broadcast(spark.createDataFrame([(int(i), float(s)) for i, s in zip(ids, base)], "question_id bigint, score double").join(scored.groupBy("question_id").count().where(F.col("count") >= k), "question_id", "left_anti"))
    first = chunks.select("chunk_id").orderBy("chunk_id").limit(2 * k).agg(F.collect_list("chunk_id").alias("all"))
    fill = few.crossJoin(first).select("question_id", F.explode("all").alias("chunk_id"), "score")
    return fill.join(scored.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti").select("question_id", "chunk_id", "score")


class _Best:
    """The k best scores of each question so far, ties by the lesser key."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.keys, self.scores = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.width = 0

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        self.new.append((np.broadcast_to(keys, scores.shape), scores))
        self.width += scores.shape[1]
        if self.width > max(8 * self.k, 2048):
            self._merge()

    def _merge(self) -> None:
        if not self.new:
            return
        keys = np.concatenate([self.keys, *(a for a, _ in self.new)], axis=1)
        scores = np.concatenate([self.scores, *(b for _, b in self.new)], axis=1)
        self.new, self.width = [], 0
        if scores.shape[1] > self.k:  # those of the k-th best score or better, then a full order among few
            least = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            most = int((scores >= least).sum(axis=1).max())
            some = np.argsort(~(scores >= least), axis=1, kind="stable")[:, :most]
            keys, scores = np.take_along_axis(keys, some, 1), np.take_along_axis(scores, some, 1)
        order = np.lexsort((keys, -scores), axis=1)[:, : self.k]
        self.keys, self.scores = np.take_along_axis(keys, order, 1), np.take_along_axis(scores, order, 1)

    def batch(self, key: str) -> pa.RecordBatch:
        self._merge()
        good = np.isfinite(self.scores)
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(self.ids[:, None], self.keys.shape)[good]), pa.array(self.keys[good]), pa.array(self.scores[good])], names=["question_id", key, "score"])


# Vectors


def metadata_filter(clauses: dict[str, object] | None, columns: list[str]) -> Column:
    """All clauses hold: ``{"$in": [...]}`` is membership of the value as it is, any other value equality as trimmed
    text. A key that is missing or NULL has the text ``None`` (and is a member only of lists that hold None)."""
    out = F.lit(True)
    for key, want in (clauses or {}).items():
        has = F.col(key) if key in columns else F.lit(None).cast("string")
        if isinstance(want, dict) and "$in" in want:
            some = [x for x in want["$in"] if x is not None]
            member = F.coalesce(has.isin(*some), F.lit(False)) if some else F.lit(False)
            out = out & (member | has.isNull() if None in want["$in"] else member)
        else:
            out = out & (F.trim(F.coalesce(has.cast("string"), F.lit("None"))) == str(want).strip())
    return out


def hash_buckets(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, idx, value): sparse signed-hash embedding before normalisation, in the JVM."""
    tokens = df.select(key, F.explode(hash_tokens(F.col(text))).alias("token"))
    return tokens.groupBy(key, token_bucket(F.col("token"), dim).alias("idx")).agg(F.sum(token_sign(F.col("token"))).cast("bigint").alias("value")).where("value <> 0")


_HAN, _LATIN = re.compile("[一-鿿]"), re.compile("[a-z0-9]+")


def hash_embed(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, vector): the same embedding, dense and of unit length (zeros without tokens), in Arrow batches."""
    places: dict[str, tuple[int, int]] = {}

    def place(token: str) -> tuple[int, int]:
        got = places.get(token)
        if got is None:
            h = hashlib.md5(token.encode()).hexdigest()
            got = int(h[:8], 16) % dim, 1 if int(h[8:10], 16) % 2 == 0 else -1
            if len(places) < 1_000_000:
                places[token] = got
        return got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, dim), np.float64)
            for i, t in enumerate(b.column("t").to_pylist()):
                low = (t or "").lower()
                han = _HAN.findall(low)
                for token in (*han, *map("".join, zip(han, han[1:])), *_LATIN.findall(low)):
                    j, sign = place(token)
                    out[i, j] += sign
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out = (out / np.where(norm > 0, norm, 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), dim).cast(pa.list_(pa.float32()))], names=[key, "vector"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, vector array<float>")


def embedder(provider: str, precomputed: DataFrame | None = None) -> Callable[[DataFrame, str, str], DataFrame]:
    """(df, key, text) -> (key, vector) by provider name: ``hash``, ``local-hash``, ``local:hash...``, ``offline`` and
    every provider whose vectors are not given hash the text; others take theirs from ``precomputed`` (key, vector)."""
    name = (provider or "").strip().lower()
    if precomputed is None or name in ("hash", "local-hash", "offline") or name.startswith("local:hash"):
        return hash_embed
    return lambda df, key, text: df.select(key).join(precomputed, key).select(key, "vector")


def vector_topk(questions: DataFrame, vectors: DataFrame, k: int = 50, metric: str = "cosine", where: Column | None = None, key: str = "chunk_id") -> DataFrame:
    """(question_id, key, score, rank): exact search of question vectors (question_id, vector) in vectors (key, vector).

    The question set is taken in blocks of QUESTION_BLOCK; a block goes to the tasks, each scores its own
    vectors with one matrix product and keeps its k best per question, and only these are merged. Scores
    are cosine, or minus the distance for ``metric="l2"``. ``where`` filters before the search. Vectors
    that are NULL, of another length or without direction are no match.
    """
    rows = (vectors if where is None else vectors.where(where)).where(F.col("vector").isNotNull()).select(F.col(key).cast("bigint").alias("k"), "vector")
    asked = [(r[0], r[1]) for r in questions.select("question_id", "vector").where("vector IS NOT NULL").toLocalIterator()]
    parts = []
    for at in range(0, max(1, len(asked)), QUESTION_BLOCK):
        block = asked[at : at + QUESTION_BLOCK]
        ids = np.array([a for a, _ in block], np.int64)
        q = np.array([v for _, v in block], np.float64)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            best = _Best(ids, k)
            for b in batches:
                vectors = b.column("vector")
                fits = pc.and_(pc.is_valid(b.column("k")), pc.equal(pc.list_value_length(vectors), q.shape[1] if len(ids) else -1))
                b = b.filter(fits)
                vectors = b.column("vector")
                if not b.num_rows:
                    continue
                x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)  # a NULL becomes NaN
                if metric == "cosine":
                    n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
                    s = np.where(n > 0, q @ x.T / np.where(n > 0, n, 1), -np.inf)
                else:
                    s = -np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)[None, :]))
                s = np.round(s, 5) + 0.0  # no minus zero
                best.add(b.column("k").to_numpy(), np.where(np.isnan(s), -np.inf, s))
            yield best.batch(key)

        parts.append(rows.mapInArrow(run, f"question_id bigint, `{key}` bigint, score double"))
    return topk(reduce(DataFrame.unionByName, parts).distinct(), k, "question_id", "score", key)


# Fusion


def rrf(*ranked: DataFrame, k: int = 60, top_n: int | None = None, key: str = "chunk_id", scores: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal-rank fusion of lists (question_id, key, rank from 1): (question_id, key, rrf_score, rank).

    Equal scores go by first appearance: the earlier list, then the better rank in it. ``scores``: names for the
    lists' own scores, carried along (NULL where a list lacks the key).
    """
    lists = [r.select("question_id", key, "rank", F.lit(n).alias("list"), *([F.col("score").alias("own")] if scores else [])) for n, r in enumerate(ranked)]
    carried = [F.max(F.when(F.col("list") == n, F.col("own"))).alias(c) for n, c in enumerate(scores)]
    fused = reduce(DataFrame.unionByName, lists).groupBy("question_id", key).agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"), F.min(F.struct("list", "rank")).alias("first"), *carried)
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("rrf", 12)), "first.list", "first.rank")
    out = fused.withColumn("rank", F.row_number().over(w)).select("question_id", key, F.round("rrf", 6).alias("rrf_score"), "rank", *scores)
    return out if top_n is None else out.where(F.col("rank") <= top_n)


def keywords_tfidf(index: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """(chunk_id, term, weight, rank): each chunk's k terms of highest tf x ln((n + 1) / df)."""
    w = index["postings"].join(index["term_df"], "term").crossJoin(F.broadcast(index["stats"]))
    scored = w.select("chunk_id", "term", F.round(F.col("tf") * F.log((F.col("n") + 1) / F.col("df")), 6).alias("weight"))
    return topk(scored, k, "chunk_id", "weight", "term")


