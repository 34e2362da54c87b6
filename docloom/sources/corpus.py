"""Reading document collections into pages and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Where texts are split, in this order.
SEPARATORS = ("\n\n", "\n", "。", "；", " ", "")


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Binary files of a folder by path; an error if there is none."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).orderBy("path")
    if not df.take(1):
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return df


def pdf_pages(binary: DataFrame) -> DataFrame:
    """(path, page_number, text): pages with text, numbered before blank ones are dropped. Needs pypdf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the package pypdf") from e
        for b in batches:
            out = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                for n, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
                    text = (page.extract_text() or "").strip()
                    if text:
                        out.append((path, n, text))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string())], names=["path", "page_number", "text"])

    return binary.select("path", "content").mapInArrow(run, "path string, page_number int, text string")


def html_text(html: Column) -> Column:
    """Text of a page of HTML: scripts, styles and tags out, common entities read, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])>", "\n"), r"(?s)<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"[ \t]+", " "))


def text_pages(df: DataFrame, key: str, text: str, mark: str = "\f") -> DataFrame:
    """Pages of texts in which form feeds part them; blank pages are dropped, their numbers stay."""
    pages = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), mark)).alias("n", "text"))
    return pages.select(key, (F.col("n") + 1).alias("page_number"), F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("text")).where("text <> ''")


def fixed_chunks(df: DataFrame, key: str, text: str, size: int = 400, overlap: int = 40) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``, in the JVM."""
    step = size - overlap
    n = F.char_length(F.col(text))
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return df.select(key, F.col(text).alias("_t"), F.posexplode(starts).alias("idx", "start")).select(key, "idx", F.substring(F.col("_t"), F.col("start") + 1, F.lit(size)).alias("piece"))


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters: split at the first separator that occurs, parts that are
    too long at the next ones, short neighbours joined up to the size with about ``overlap`` repeated."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    sep, rest = next(((s, separators[i + 1 :]) for i, s in enumerate(separators) if s == "" or s in text), ("", ()))
    if sep == "":
        step = size - overlap
        return [p for p in (text[a : a + size].strip() for a in range(0, max(1, len(text) - overlap), step)) if p]
    parts = [p + sep for p in text.split(sep)[:-1]] + [text.split(sep)[-1]]
    out: list[str] = []
    cur: list[str] = []
    n = 0
    for p in (p for p in parts if p):
        if n + len(p) > size and cur:
            out.append("".join(cur))
            while cur and (n > overlap or n + len(p) > size):
                n -= len(cur.pop(0))
        if len(p) > size:
            if cur:
                out.append("".join(cur))
            cur, n = [], 0
            out += recursive_pieces(p, size, overlap, rest)
            continue
        cur.append(p)
        n += len(p)
    if cur:  # ends with a part that is in no piece yet
        out.append("".join(cur))
    return [p.strip() for p in out if p.strip()]


def recursive_chunks(df: DataFrame, key: str, text: str, size: int = 400, overlap: int = 40) -> DataFrame:
    """(key, idx, piece) by recursive splitting; sizes below 180 and overlaps below 20 are raised to these."""
    size, overlap = max(180, size), max(20, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, i, p) for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist()) for i, p in enumerate(recursive_pieces(t or "", size, overlap))]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], b.schema.field("k").type), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string())], names=[key, "idx", "piece"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, idx int, piece string")


def chunk_key(name: Column, page: Column, idx: Column, piece: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-1 of name, page, index and first 80 characters."""
    return F.substring(F.sha1(F.concat_ws("|", F.coalesce(name, F.lit("")), F.coalesce(page.cast("string"), F.lit("")), idx.cast("string"), F.substring(piece, 1, 80))), 1, 16)


def by_ids(chunks: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of the wanted keys (key, rank) in that order; keys that do not exist are skipped."""
    return chunks.join(wanted, key).orderBy("rank")


def without_document(chunks: DataFrame, document_ids: DataFrame) -> DataFrame:
    """The chunk table after some documents were deleted."""
    return chunks.join(document_ids.select("document_id").distinct(), "document_id", "left_anti")
