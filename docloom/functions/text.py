"""Column functions over texts. NULL in, NULL out unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 384
# The labels and marks of what an excerpt drops at its beginning, and the ends of sentence parts.
EXCERPT_LABEL = r"^(?:文档名称|产品名称|文档类型|生效日期|状态)[：:][^。；;]{0,40}[。；;\s]*"
PART_ENDS = "[。；;!?！？\n]"


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def hash_tokens(text: Column) -> Column:
    """Han characters, then their bigrams over the Han characters alone, then runs of a-z and 0-9."""
    low = F.lower(text)
    han = F.regexp_extract_all(low, F.lit("[一-鿿]"), F.lit(0))
    pairs = F.when(F.size(han) > 1, F.zip_with(F.slice(han, F.lit(1), F.size(han) - 1), F.slice(han, F.lit(2), F.size(han) - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(han, pairs, F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)))


def token_bucket(token: Column, dim: int = DIM) -> Column:
    """Place of a token in a signed-hash embedding: first eight hexadecimal digits of its md5."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(dim))


def token_sign(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(token), 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def query_terms(text: Column, most: int = 6) -> Column:
    """Distinct runs of letters and digits, in order, of two characters or more (or holding 险)."""
    runs = F.regexp_extract_all(F.trim(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(runs, lambda t: (F.char_length(t) >= 2) | F.contains(t, F.lit("险")))), 1, most)


def truncated(text: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def excerpt(text: Column, n: int = 180) -> Column:
    """White space collapsed, one leading label run dropped, cut at ``n`` with an ellipsis."""
    flat = collapse(F.coalesce(text, F.lit("")))
    body = F.regexp_replace(flat, EXCERPT_LABEL, "")
    return truncated(F.trim(body), n, "…")


def needle(text: Column) -> Column:
    """What to highlight: the longest sentence part of 8 to 48 characters (the first of equals), else the first 36."""
    flat = collapse(F.coalesce(text, F.lit("")))
    parts = F.filter(F.transform(F.split(flat, PART_ENDS), lambda p: F.trim(p)), lambda p: F.char_length(p).between(8, 48))
    longest = F.aggregate(parts, F.lit(""), lambda best, p: F.when(F.char_length(p) > F.char_length(best), p).otherwise(best))
    return F.when(longest != "", longest).otherwise(F.substring(flat, 1, 36))


def first_citation(text: Column, available: Column) -> Column:
    """Number in the first [n] of an answer; 1 if there is none or no such citation."""
    n = F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"\[(\d{1,3})\]", 1), F.lit("")), F.lit("999")).cast("int")
    return F.when(n.between(1, available), n).otherwise(1)


def link_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\[(\d{1,3})\]", "<cite n=$1>")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def answer_sections(text: Column) -> Column:
    """[{title, body}] of the 【title】 parts if there are two or more, titles folded to conclusion, evidence, boundary."""
    t = F.coalesce(text, F.lit(""))
    titles = F.regexp_extract_all(t, F.lit("【([^】]+)】"), F.lit(1))
    bodies = F.transform(F.regexp_extract_all(t, F.lit("】([^【]*)"), F.lit(1)), lambda b: F.trim(F.regexp_replace(b, r"^\s+|\s+$", "")))
    fold = lambda x: F.when(F.contains(x, F.lit("结论")), "conclusion").when(F.contains(x, F.lit("依据")), "evidence").when(F.contains(x, F.lit("边界")), "boundary").otherwise(x)
    pairs = F.zip_with(titles, bodies, lambda a, b: F.struct(fold(a).alias("title"), b.alias("body")))
    return F.when(F.size(titles) >= 2, pairs).otherwise(F.array().cast("array<struct<title:string,body:string>>"))


def locate_excerpt(page: Column, part: Column) -> Column:
    """1-based place of an excerpt in a page, by its first 12 characters if the whole is not there, else 0."""
    head = F.substring(part, 1, 12)
    return F.when(F.coalesce(part, F.lit("")) == "", 0).otherwise(F.coalesce(F.nullif(F.position(part, page), F.lit(0)), F.position(head, page), F.lit(0)))


def query_vectors(rewriting: Column) -> Column:
    """[{title, query}] of a rewriting's ``query_vectors``: strings are variants, objects have their names in either of
    two ways; other elements are NULL. NULL if it is no object with a list of them."""
    items = F.from_json(F.get_json_object(F.when(F.try_parse_json(rewriting).isNotNull(), rewriting), "$.query_vectors"), "array<string>")
    full = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))

    def one(x: Column) -> Column:
        inner = F.when(x.startswith("{"), x)
        named = F.struct(F.coalesce(full(F.get_json_object(inner, "$.title"), F.get_json_object(inner, "$.vector_type")), F.lit("变体")).alias("title"), F.coalesce(full(F.get_json_object(inner, "$.query"), F.get_json_object(inner, "$.text")), F.lit("")).alias("query"))
        return F.when(x.isNull(), None).when(inner.isNotNull(), named).otherwise(F.struct(F.lit("变体").alias("title"), x.alias("query")))

    return F.transform(items, one)


def strip_fences(text: Column) -> Column:
    """What is inside the first code fence, or the text itself."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)```", 1)
    return F.when(F.regexp_like(text, F.lit(r"(?s)```.*?```")), F.trim(F.regexp_replace(inner, r"^\s+|\s+$", ""))).otherwise(F.trim(text))


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer: the text without fences, or its outermost braces; NULL if neither parses."""
    body = strip_fences(text)
    outer = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), body).when((outer != "") & F.try_parse_json(outer).isNotNull(), outer)
