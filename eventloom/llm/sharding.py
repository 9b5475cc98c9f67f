"""Operator 3: shards that all match the mixture of sources (proportional stratified interleaving).

Rows are shuffled with a seed within their source and ranked there.  The row of rank r among n gets
the fraction (2r+1)/2n; sorted by that fraction, every stretch of the order holds each source in
proportion, so equal cuts of it are shards with the mixture of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import grouped_rank


def stratum(column: Column) -> Column:
    """Group key that is never null: a null source is a stratum of its own."""
    return F.when(column.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), column.cast("string")))


def text_size(text: Column) -> Column:
    """Bytes of the text in UTF-8 (null: none) and 16 for its frame."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def interleave(docs: DataFrame, n_shards: int, seed: int = 17, source: str = "source", key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: key, the columns in ``keep``, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: shards differ by one row at most, slots have no gap.  A null source is a source of its
    own; a null text has size 16 and crc 0; a null key is a key like any other; rows that agree in key
    and text are interchangeable, each gets a place of its own.  No rows: an empty result with the same
    columns.  Columns that are neither key, text, source nor kept are not read; kept ones may have any name
    but those of the result.
    """
    rows = docs.select(
        F.col(key),
        *(F.col(c) for c in keep or []),
        stratum(F.col(source)).alias("_stratum"),
        text_size(F.col(text)).alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("_shuffled"),
    )
    ranked = grouped_rank(rows, ["_stratum"], ["_shuffled", key, "text_crc32"], "_rank", "_n")
    ranked = ranked.withColumn("_fraction", (2 * F.col("_rank") + 1) / (2 * F.col("_n")))
    placed = grouped_rank(ranked.drop("_rank", "_n"), [], ["_fraction", "_stratum"], "_place", "_all")
    shard = F.expr(f"_place * {n_shards} div _all")
    return placed.withColumn("shard", shard.cast("int")).select(
        key,
        *(keep or []),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_place") - F.expr(f"(shard * _all + {n_shards} - 1) div {n_shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int, seed: int = 17, source: str = "source", key: str = "doc_id", text: str = "text") -> None:
    """Writes whole rows as Parquet under ``path/shard=K``, in slot order within each file.

    Only keys and hashes are ranked; a row meets its place through its key, text and the number of its copy, so texts
    are moved once.  The columns written are those of docs, with ``slot`` and ``shard`` added; a column of docs with such a
    name, in any case, is refused.
    """
    if clash := {c for c in docs.columns if c.lower() in ("slot", "shard")}:
        raise ValueError(f"columns {sorted(clash)} have the names of the places")
    placed = interleave(docs, n_shards, seed, source, key, text)
    # rows that agree in key and text are interchangeable, so long as each gets a place of its own
    copy = lambda df, order: grouped_rank(df, ["_sk", "_sc", "_ss"], order, "_sn")
    places = placed.select(F.col(key).alias("_sk"), F.col("text_crc32").alias("_sc"), F.col("size").alias("_ss"), "slot", "shard")
    places = copy(places, ["shard", "slot"])
    whole = docs.withColumns({"_sk": F.col(f"`{key}`"), "_sc": F.coalesce(F.crc32(F.col(f"`{text}`")), F.lit(0)).cast("long"), "_ss": text_size(F.col(f"`{text}`"))})
    whole = copy(whole, [F.xxhash64(F.col(f"`{source}`"))])
    met = whole["_sk"].eqNullSafe(places["_sk"])
    for c in ("_sc", "_ss", "_sn"):
        met = met & (whole[c] == places[c])
    out = whole.join(places, met).select(*[whole[c] for c in docs.columns], "slot", "shard")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
