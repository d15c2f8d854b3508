"""The corpus pipeline: quality rules, near-duplicates, secrets, packing. Each stage works on all that the former kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.lineage import drop_folder, shared_folder, written
from graphloom.llm import overlap, packing, quality, secrets, simhash
from graphloom.llm.queries import pattern, vocabulary

#: Folders that stages of this session wrote for themselves; run() deletes them.
SCRATCH: list[str] = []


def whole(docs: DataFrame) -> Column:
    """A row as one column, so that no name of a table's own can clash with what an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def parts(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of such a row, some of them replaced."""
    return [(new.get(c, F.col("doc")[c])).alias(c) for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, all columns as they are; it reads text and lang.

    A null or empty text has too few words and goes; a null language is judged with the unlisted ones; repeated rows stay or
    go together; an empty table gives none. Columns may have any names.
    """
    return quality.quality_rules(docs.select(whole(docs), "text", "lang")).where(F.col("_q.kept")).select(*parts(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: the smallest id, null ids last; of rows with that id, by the other columns.

    Documents are linked as in op8, and where their sets of five-word shingles have Jaccard similarity 0.8 or more. An
    id links nothing: rows with one id, or none, and different texts are different documents. It reads doc_id and text; a
    null text counts as empty, and empty ones are one group; an empty table gives none; columns may have any names.
    """
    folder = shared_folder(spark, "near-duplicates")
    SCRATCH.append(folder)
    keep = lambda df: written(df, folder)
    rows = keep(docs.select(whole(docs), F.monotonically_increasing_id().alias("_row")))  # the numbers of the rows stay
    texts = rows.select("_row", F.col("doc")["text"].alias("text"))
    own = F.col("doc")["doc_id"]
    place = F.struct(own.isNull().alias("none"), own.alias("doc_id"), F.xxhash64("doc").alias("hash"), "_row").alias("_place")
    prints = keep(overlap.sketches(rows.select("_row", place, F.col("doc")["text"].alias("text")), "text", ["_row", "_place"]))
    nodes = keep(prints.groupBy("_fp", "_set").agg(F.min("_row").alias("id"), F.min("_place").alias("best")))
    by_fp = keep(nodes.groupBy("_fp").agg(F.min("id").alias("at")))
    sets = keep(prints.select("_set", "_row", "_n", "_bands").groupBy("_set").agg(F.min("_row").alias("id"), F.first("_n").alias("_n"), F.first("_bands").alias("_bands")))
    same = nodes.join(by_fp, "_fp").select("id", "at").union(nodes.join(sets.select("_set", F.col("id").alias("at")), "_set").select(nodes["id"], "at"))
    near = simhash.near_links(by_fp, 4, by_fp.count())
    for x in "uv":
        near = near.join(by_fp.select(F.col("_fp").alias(x), F.col("at").alias(f"_{x}")), x)
    known = keep(same.union(near.select(F.greatest("_u", "_v"), F.least("_u", "_v"))).toDF("u", "v").where("u <> v").distinct())
    roots = overlap.overlap_groups(sets, known, texts, "_row", "text")
    named = nodes.join(roots, nodes["id"] == roots["node"], "left").select("best", F.coalesce("root", "id").alias("root"))
    first = named.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best._row").alias("_row"))
    return rows.join(first, "_row", "left_semi").select(*parts(docs))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with a mark in place of each secret, and n_chars, where there is such a column, of the new text.

    It reads text. A null text has no secrets and stays null, repeated rows stay, an empty table gives none, and columns
    may have any names.
    """
    out = secrets.scan_secrets(docs.select(whole(docs), "text"), vocabulary("byte_bpe_50k.tiktoken"), pattern(), redact=True, keep=["doc"])
    new = {"text": F.col("_redacted")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("_spans") > 0, F.length("_redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc")["n_chars"])
    return out.select(*parts(docs, **new))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: where it goes. It reads doc_id and text; a null text is an empty one and still a piece; an empty table gives none."""
    pieces = packing.tokenized_pieces(docs, vocabulary("word_bpe_49k.json"), keep=["doc_id"])
    out = packing.best_fit(pieces, order=("doc_id", "_piece"))
    return out.select("doc_id", *[F.col(f"_{x}").alias(y) for x, y in (("piece", "piece"), ("start", "start"), ("length", "length"), ("ids_crc32", "ids_crc32"), ("sequence", "sequence_id"), ("offset", "offset"))])


STAGES = [("quality_rules", quality_stage), ("simhash_near_dedup", near_duplicate_stage), ("secret_scans", secrets_stage), ("best_fit_packing", packing_stage)]

#: SQL can express neither the fingerprints nor the token test; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again by the next.

    The last stage keeps what it needs in a checkpoint of its own, so nothing written before is needed after it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        while SCRATCH:
            drop_folder(spark, SCRATCH.pop())
        SCRATCH.append(path)
        docs = spark.read.parquet(path)
    out = STAGES[-1][1](spark, docs, sf_dir)
    while SCRATCH:
        drop_folder(spark, SCRATCH.pop())
    return out
