"""Names and keys: file, symbol and document ids, content hashes and edge keys, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """Forward slashes, and no `./` in front."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def _segments(parts: Column, odd: str, edge: str) -> Column:
    clean = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), odd, "_"), edge, ""))
    return F.filter(clean, lambda s: s != "")


def file_id(path: Column) -> Column:
    """Each path segment in small letters, what is neither letter, digit nor dot as `_`, joined by `_`."""
    return F.array_join(_segments(F.split(path, "/"), r"[^a-z0-9.]+", r"^[._]+|[._]+$"), "_")


def symbol_id(path: Column, name: Column) -> Column:
    """The file's id, a colon, and the qualified name's segments joined by dots."""
    return F.concat(file_id(path), F.lit(":"), F.array_join(_segments(F.split(name, r"\."), r"[^a-z0-9]+", r"^_+|_+$"), "."))


def document_id(path: Column) -> Column:
    """doc_, the slug of the whole path (`source` if that is empty), and eight digits of the SHA-256 of the path with forward slashes."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(path), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    digest = F.sha2(F.translate(path, "\\", "/").cast("binary"), 256)
    return F.concat(F.lit("doc_"), F.when(slug == "", "source").otherwise(slug), F.lit("_"), F.substring(digest, 1, 8))


def content_hash(text: Column) -> Column:
    """h = 33 h + unit over UTF-16 units from 5381, modulo 2**32, in base 36."""
    units = F.split(F.hex(F.encode(text, "UTF-16BE")), "(?<=\\G.{4})")
    value = F.aggregate(F.filter(units, lambda u: u != ""), F.lit(5381).cast("long"), lambda h, u: F.pmod(h * 33 + F.conv(u, 16, 10).cast("long"), F.lit(1 << 32)))
    return F.lower(F.conv(value.cast("string"), 10, 36))


def edge_key(edges: DataFrame) -> Column:
    """`s->t_relation`, after cog_ or sus_ for edges of those types."""
    prefix = F.when(edges["type"] == "COGNITIVE", "cog_").when(edges["type"] == "SUSPICIOUS", "sus_").otherwise("")
    return F.concat(prefix, edges["source"], F.lit("->"), edges["target"], F.lit("_"), edges["relation"])


def with_ordinals(df: DataFrame, base: str, position: list[str], to: str) -> DataFrame:
    """The second and later rows of a base id, by position, get ~2, ~3 and so on."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*position))
    return df.withColumn(to, F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("~"), n.cast("string"))))
