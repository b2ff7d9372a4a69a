"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z; a null text is an empty one.

1. A first pass keeps the byte length and the first characters of each text. Lengths are counted.
2. Rows whose length occurs again get a hash of these characters; (length, prefix hash) is counted.
3. A second pass hashes the whole content (SHA-256) of rows whose length and prefix hash occur again, and of no others.
   Rows of one length and full hash form a group.

What occurs again is kept as a table of bits, one per hash value: eight bits a row, at most 2**27 bits (16 MB), so it is broadcast with a
proven bound. A bit may be set by another value too; this lets a row through to the next step, which decides it, and never loses one. So no
text is shuffled: only counts, and then 32 bytes a row of the survivors. All counts are summed inside each task first, so a length, a prefix
or a text that a third of all rows share costs no more than another.

The row with the largest id of a group stays; of rows that repeat this id and text, exactly one. Null ids count as smaller than all
others. A row without equals stays and has itself as keep_id. An empty table gives an empty result. Very long texts are held one at a time.
Columns besides id, text and ``carry`` are ignored, so names that clash do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.llm.common import Workspace

PREFIX = 64
MOST_BITS = 27


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null is empty. Pure ASCII texts take the faster function."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def bit_exponent(rows: int) -> int:
    return min(MOST_BITS, max(15, math.ceil(math.log2(8 * max(rows, 1)))))


def _place(keys: list[str], exponent: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(2**exponent)) + 1


def occurring_again(rows: DataFrame, keys: list[str], exponent: int) -> DataFrame:
    """(_bucket, _bits): a bit for the hash of each key that two rows or more have; 2**(exponent - 15) rows of 4 KB at most."""
    return bit_table(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1"), keys, exponent)


def bit_table(rows: DataFrame, keys: list[str], exponent: int) -> DataFrame:
    """(_bucket, _bits): a bit for the hash of each row's key."""
    return rows.select(_place(keys, exponent).alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))


def flagged(rows: DataFrame, keys: list[str], bits: DataFrame, exponent: int) -> DataFrame:
    """``rows`` with the boolean _again: whether the bit of the row's key is set."""
    byte = F.expr("cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_place) DIV 8 AS int) + 1, 1)), 16, 10) AS int)")
    bit = F.expr("shiftright(_byte, cast(bitmap_bit_position(_place) % 8 AS int)) & 1 = 1")
    spread = rows.withColumn("_place", _place(keys, exponent)).withColumn("_bucket", F.bitmap_bucket_number("_place"))
    return spread.join(F.broadcast(bits), "_bucket", "left").withColumn("_byte", byte).withColumn("_again", F.coalesce(bit, F.lit(False))).drop("_place", "_bucket", "_bits", "_byte")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix: int = PREFIX, carry: tuple[str, ...] = (), most_bits: int = MOST_BITS) -> DataFrame:
    """Per row: id_col, keep_id, group_size, kept, and the columns of ``carry``."""
    ws = Workspace(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    length, head = F.octet_length(text).alias("_length"), F.left(text, F.lit(prefix)).alias("_head")
    heads = ws.put(docs.select(length, head), "heads")
    exponent = min(most_bits, bit_exponent(heads.count()))
    lengths = ws.put(occurring_again(heads, ["_length"], exponent), "lengths")
    hashed = flagged(heads, ["_length"], lengths, exponent).where("_again").select("_length", F.xxhash64(ascii_lower(F.col("_head"))).alias("_prefix"))
    prefixes = ws.put(occurring_again(hashed, ["_length", "_prefix"], exponent), "prefixes")

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)], length,
                         F.xxhash64(ascii_lower(head)).alias("_prefix"))
    full = F.when(F.col("_again"), F.unhex(F.sha2(ascii_lower(F.col("_text")), 256))).alias("_full")
    kept_columns = [f"_carry{i}" for i in range(len(carry))]
    rows = ws.put(flagged(narrow, ["_length", "_prefix"], prefixes, exponent).select("_id", *kept_columns, "_length", full, F.monotonically_increasing_id().alias("_row")), "rows")
    survivors = rows.where("_full IS NOT NULL")
    # Stored, so that the join alone deals out the rows and Spark can split a group that is too large for a task.
    groups = ws.put(survivors.groupBy("_length", "_full").agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count("*").alias("_size")).where("_size > 1"), "groups")
    marked = survivors.join(groups, ["_length", "_full"], "left").select("_id", *kept_columns, "_row", "_keep", "_size")
    nothing = groups.select("_keep", "_size").schema
    alone = rows.where("_full IS NULL").select("_id", *kept_columns, "_row", *[F.lit(None).cast(f.dataType).alias(f.name) for f in nothing])
    return ws.finish(marked.union(alone).select(
        F.col("_id").alias(id_col), F.when(F.col("_keep").isNull(), F.col("_id")).otherwise(F.col("_keep._id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("_keep._row") == F.col("_row"), F.lit(True)).alias("kept"),
        *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)]))
