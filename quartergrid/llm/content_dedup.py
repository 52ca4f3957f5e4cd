"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, an external sort places equal
texts side by side, and each run of full equals becomes one row. A splitter is the head of a
text, its digest and a salt. So the driver sees no whole text of the sample, and a text that
fills a third of the table is cut over many ranges; its few remaining rows, one per salt,
meet again on their digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartergrid.llm.joins import free, sized
from quartergrid.session import durable

BLANKS = " \t\n\x0b\x0c\r"
HEAD = 64


def mark_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: which document of its equals stays.

    Texts are equal when they match after all blanks (space, tab to carriage return) are
    deleted. The row with the most code points in its original text stays, then the
    smallest id; a null id comes after all others. A null text counts as empty, so all
    empty, blank and null texts are one group. Rows that repeat the id of the staying row
    are the same document and stay with it. Other columns are not looked at. An empty
    table gives no rows.

    Columns: ``doc_id``, ``keep_id``, ``group_size`` (rows), ``kept``, ``text_sha256``.
    """
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    original = F.coalesce(docs[text], F.lit(""))
    normal = F.translate(original, BLANKS, "")
    each = docs.select(
        docs[doc_id].alias("doc_id"),
        normal.alias("content"),
        F.substring(normal, 1, HEAD).alias("head"),
        F.struct(-F.length(original), docs[doc_id].isNull(), docs[doc_id].alias("id")).alias("rank"),
        F.sha2(normal, 256).alias("text_sha256"),
        F.pmod(F.xxhash64(docs[doc_id]), F.lit(salts)).alias("salt"),
    )
    runs = (
        each.repartitionByRange("head", "text_sha256", "salt")
        .sortWithinPartitions("head", "text_sha256", "content", "salt")
        .groupBy("head", "text_sha256", "content", "salt")
        .agg(
            F.min("rank").alias("rank"),
            F.count(F.lit(1)).alias("copies"),
        )
    )
    equals = Window.partitionBy("text_sha256")
    groups = runs.select(
        "text_sha256",
        "salt",
        F.min("rank").over(equals)["id"].alias("keep_id"),
        F.sum("copies").over(equals).alias("group_size"),
    )
    return (
        each.select("doc_id", "text_sha256", "salt")
        .join(groups, ["text_sha256", "salt"])
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
        )
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """Rows of ``docs`` whose document stays, with all their columns.

    A row is judged by its own text: a row with the same or a null id and another text is
    not touched. With ``row``, a column that is different in every row, exactly one row of
    each group stays: of those that :func:`mark_copies` keeps, the first by ``row``.
    Without it rows that repeat the id and the text of the staying row stay too.
    """
    digest = F.sha2(F.translate(F.coalesce(docs[text], F.lit("")), BLANKS, ""), 256)
    marked = mark_copies(docs, doc_id, text)
    name, of = free("_gone", docs), free("_of", docs)
    if row is None:
        gone = marked.where("NOT kept").select(F.col("doc_id").alias(name), F.col("text_sha256").alias(of)).distinct()
        return docs.join(sized(durable(gone)), docs[doc_id].eqNullSafe(F.col(name)) & (digest == F.col(of)), "left_anti")
    copied = durable(marked.where("group_size > 1").select("text_sha256").distinct())
    each = docs.select(
        docs[row].alias("_row"),
        digest.alias("text_sha256"),
        F.struct(
            -F.length(F.coalesce(docs[text], F.lit(""))), docs[doc_id].isNull(), docs[doc_id].alias("id"), docs[row].alias("row")
        ).alias("rank"),
    )
    among = durable(each.join(sized(copied), "text_sha256"))
    stays = among.groupBy("text_sha256").agg(F.min("rank")["row"].alias("_row")).select("_row")
    gone = durable(among.select("_row").join(stays, "_row", "left_anti").withColumnRenamed("_row", name))
    return docs.join(sized(gone), docs[row] == F.col(name), "left_anti")
