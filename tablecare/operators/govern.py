"""Anonymising, erasure, export, consent, retention, hash chains and encryption."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.ordered import framed, row_numbers
from tablecare.session import settle

# Field kinds and what replaces them.
NAME_FIELDS = ("name", "first_name", "last_name")
OTHER_FIELDS = ("phone", "address", "ssn", "credit_card")


def anonymize(df: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """Personal fields to fixed values; ``fields`` maps columns to kinds, by default columns named like a kind."""
    kinds = fields or {c: c for c in df.columns if c in ("email", "ip_address", *NAME_FIELDS, *OTHER_FIELDS)}
    out = {}
    for c, kind in kinds.items():
        if kind == "email":
            new = F.concat(F.substring(F.sha2(F.col(c), 256), 1, 8), F.lit("@anonymous.com"))
        elif kind in NAME_FIELDS:
            new = F.lit("ANONYMIZED")
        else:
            new = F.lit("0.0.0.0" if kind == "ip_address" else "[REDACTED]")
        out[c] = F.when(F.col(c).isNotNull(), new)
    return df.withColumns(out)


def pseudonym(c: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", c.cast("string"), F.lit(salt)), 256), 1, 16)


def pseudonymize(df: DataFrame, ids: list[str], salt: str) -> tuple[DataFrame, DataFrame]:
    """Id columns to salted hashes, and the mapping table (pseudonym, original)."""
    out = df.withColumns({c: pseudonym(F.col(c), salt) for c in ids})
    pairs = F.array(*[F.struct(pseudonym(F.col(c), salt).alias("pseudonym"), F.col(c).cast("string").alias("original")) for c in ids])
    return out, df.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def erase(events: DataFrame, erased: DataFrame, key: str, json_col: str | None = None) -> DataFrame:
    """Rows of erased ids lose the id, and the id inside their JSON text; other rows are untouched.

    The list decides per id, so it is joined as a flag after its duplicates are gone.
    """
    from tablecare.functions.params import attach

    flagged = attach(events, erased.select(key).distinct().withColumn("_gone", F.lit(True)), [key])
    gone = F.coalesce("_gone", F.lit(False))
    out = {key: F.when(~gone, F.col(key))}
    if json_col:
        hidden = F.regexp_replace(json_col, f'("{key}"\\s*:\\s*)("[^"]*"|[^,}}\\s]+)', '$1"ANONYMIZED"')
        out[json_col] = F.when(gone, hidden).otherwise(F.col(json_col))
    return flagged.withColumns(out).select(*events.columns)


def export_user(tables: dict[str, tuple[DataFrame, str]], ids) -> DataFrame:
    """All rows of the wanted ids from every table, as (table, id, row in JSON)."""
    out = None
    for name, (df, key) in tables.items():
        rows = df.where(F.col(key).isin(list(ids))).select(
            F.lit(name).alias("table_name"), F.col(key).cast("string").alias("id"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def consent_state(df: DataFrame, keys: list[str], status: str, updated: list[str], expires: Column, now: Column) -> DataFrame:
    """Newest status per key; a granted one counts while it has not expired."""
    at = F.struct(*[F.col(c) for c in updated])
    newest = df.withColumn("_exp", expires).groupBy(*keys).agg(F.max_by(F.struct(status, "_exp"), at).alias("v"))
    return newest.select(*keys, F.col(f"v.{status}").alias("status"),
                         ((F.col(f"v.{status}") == "granted") & (F.col("v._exp").isNull() | (F.col("v._exp") > now))).alias("active"))


def retention_split(df: DataFrame, ts: str, days: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """(expired rows for the archive, rows to keep)."""
    expired = F.col(ts) + F.expr(f"INTERVAL {days} DAYS") <= now
    return df.where(expired), df.where(~expired)


def rewrite_partitions(df_path: str, touched: DataFrame, by: str, change, staging: str) -> int:
    """Rewrite only the partitions (column ``by``) that ``touched`` names; gives their number.

    ``change`` takes the rows of these partitions and gives what stays of them. The new rows are written to ``staging`` first and replace the
    old ones partition by partition; the files of all others stay as they are. A partition that nothing stays of is left with an empty file.
    Run again after a failure it does the same work from what is there, so a change that may be done twice is safe. The values of ``by``, one
    per partition, pass through the driver.
    """
    spark = touched.sparkSession
    names = sorted({str(r[0]) for r in touched.select(F.col(by).cast("string")).distinct().collect() if r[0] is not None})
    if not names:
        return 0
    table = spark.read.parquet(df_path)
    changed = change(table.where(F.col(by).cast("string").isin(names)))
    changed.write.mode("overwrite").partitionBy(by).parquet(staging)
    staged = spark.read.schema(table.schema).parquet(staging)
    left = {str(r[0]) for r in staged.select(F.col(by).cast("string")).distinct().collect()}
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(df_path)
    for name in names:
        if name not in left:
            table.drop(by).limit(0).coalesce(1).write.mode("overwrite").parquet(f"{df_path}/{by}={name}")
    return len(names)


def erase_stored(path: str, ids: DataFrame, key: str, by: str, staging: str, note: str | None = None) -> int:
    """Erase users in a stored table; only the partitions that hold one of them are rewritten."""
    rows = ids.sparkSession.read.parquet(path)
    touched = rows.select(by, key).join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi").select(by)
    return rewrite_partitions(path, touched, by, lambda part: erase(part, ids, key, note) if note else erase(part, ids, key), staging)


def retain_stored(spark, path: str, archive: str, ts: str, days: int, now: Column, by: str, staging: str) -> int:
    """Move rows past their retention to the archive; only partitions that hold such rows are rewritten.

    The archive is partitioned like the table and its partitions are replaced, not added to, with what they had and what has expired since.
    Equal rows expire together, so those that a failed run had archived already are told by their values and not archived twice.
    """
    rows = spark.read.parquet(path)
    expired, _ = retention_split(rows, ts, days, now)
    touched = settle(expired.select(by).distinct())
    names = [str(r[0]) for r in touched.select(F.col(by).cast("string")).collect()]
    if not names:
        return 0
    old = expired
    try:
        before = spark.read.schema(rows.schema).parquet(archive).where(F.col(by).cast("string").isin(names))
        old = before.exceptAll(expired.select(before.columns)).unionByName(expired)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    settle(old).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(archive)
    return rewrite_partitions(path, touched, by, lambda part: retention_split(part, ts, days, now)[1], staging)


def event_text(fields: list[str]) -> Column:
    """The text of an event that goes into its hash."""
    return F.to_json(F.struct(*[F.col(c) for c in fields]))


def hash_chain(df: DataFrame, keys: list[str], order: list[str], fields: list[str], segment: int = 500000, heads: DataFrame | None = None) -> DataFrame:
    """Chain hash of each event: sha256 of the hash before it and the event text, per key in order.

    The chain is sequential by definition. It is walked segment by segment: each round chains one segment of
    every key in parallel, starting from the last hash of the segment before, so no task reads more than one
    segment of a key at a time; the keys of a task are walked in one go, sorted, and only a batch of rows is held. ``heads`` (keys, _prev) are the hashes to go on from.
    """
    rows = settle(row_numbers(df.withColumn("_text", event_text(fields)), keys, order)
                  .withColumn("_seg", F.floor((F.col("_rn") - 1) / segment)))
    last = rows.agg(F.max("_seg")).first()[0]
    schema = T.StructType([*rows.schema.fields, T.StructField("chain_hash", T.StringType())])

    def walk(batches):
        # Rows come sorted by key and place, so the hash is carried from row to row; a key begins where its segment does.
        prev = ""
        for batch in batches:
            out = []
            places, texts, starts = (batch.column(c).to_pylist() for c in ("_rn", "_text", "_prev"))
            for place, text, head in zip(places, texts, starts):
                if (place - 1) % segment == 0:
                    prev = head or ""
                prev = hashlib.sha256(f"{prev}:{text}".encode()).hexdigest()
                out.append(prev)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rows_columns], pa.array(out, pa.string())], names=[*rows_columns, "chain_hash"])

    rows_columns = list(rows.columns)
    if last is None:
        return rows.withColumn("chain_hash", F.lit(None).cast("string")).drop("_text", "_seg")
    chained = None
    for seg in range(int(last) + 1):
        part = rows.where(F.col("_seg") == seg)
        if heads is None:
            part = part.withColumn("_prev", F.lit(None).cast("string"))
        else:  # a null key is a key too
            part = part.join(heads, [part[k].eqNullSafe(heads[k]) for k in keys], "left").select(*[part[c] for c in part.columns], "_prev")
        done = settle(part.repartition(*keys).sortWithinPartitions(*keys, "_rn").mapInArrow(walk, schema))
        heads = done.groupBy(*keys).agg(F.max_by("chain_hash", "_rn").alias("_prev"))
        chained = done if chained is None else chained.unionByName(done)
    return chained.drop("_text", "_seg", "_rn")


class ChainStore:
    """A stored chain that grows by batches. Each append writes a version: its chained events, and the last hash and place of every key.

    A batch goes on from the stored heads, so nothing that was chained before is read. Events at or before their key's head are not chained
    again: a batch that comes twice, or a run that failed before its heads were written, changes nothing (its version is written anew).
    """

    def __init__(self, spark, path: str, keys: list[str], order: list[str], fields: list[str], segment: int = 500000):
        self.spark, self.path, self.keys, self.order, self.fields, self.segment = spark, path, keys, order, fields, segment

    def _versions(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.path}/heads").agg(F.max("version")).first()[0] or 0
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return 0

    def heads(self) -> DataFrame | None:
        """keys, _prev (last hash) and _at (its place in the order) of every key, or None."""
        version = self._versions()
        return self.spark.read.parquet(f"{self.path}/heads/version={version}") if version else None

    def events(self) -> DataFrame:
        version = self._versions()
        return self.spark.read.parquet(f"{self.path}/events").where(F.col("version") <= version).drop("version")

    def append(self, batch: DataFrame) -> int:
        """Chain the events of a batch that lie behind their key's head; gives their number."""
        version, old = self._versions() + 1, self.heads()
        at = F.struct(*[F.col(c) for c in self.order])
        fresh = batch
        if old is not None:
            on = [batch[k].eqNullSafe(old[k]) for k in self.keys]
            fresh = batch.join(old.drop("_prev"), on, "left").where(F.col("_at").isNull() | (at > F.col("_at"))).select(*[batch[c] for c in batch.columns])
        fresh = settle(fresh)
        count = fresh.count()
        if not count:
            return 0
        chained = hash_chain(fresh, self.keys, self.order, self.fields, self.segment, None if old is None else old.drop("_at"))
        chained.write.mode("overwrite").parquet(f"{self.path}/events/version={version}")
        written = self.spark.read.parquet(f"{self.path}/events/version={version}")
        now = written.groupBy(*self.keys).agg(F.max_by("chain_hash", at).alias("_prev"), F.max(at).alias("_at"))
        if old is not None:
            now = now.unionByName(old.join(now.select(*self.keys), [old[k].eqNullSafe(now[k]) for k in self.keys], "left_anti"))
        now.write.mode("overwrite").parquet(f"{self.path}/heads/version={version}")
        return count


def verify_chain(df: DataFrame, keys: list[str], order: list[str], fields: list[str], stored: str = "chain_hash") -> DataFrame:
    """Recompute each hash from the stored hash before it; parallel, since nothing is carried."""
    def build(w):
        prev = F.coalesce(F.lag(stored).over(w), F.lit(""))
        return {"link_ok": F.sha2(F.concat(prev, F.lit(":"), event_text(fields)), 256) == F.col(stored)}

    return framed(df, keys, order, 1, build)


def chain_report(links: DataFrame, keys: list[str]) -> DataFrame:
    good = F.count_if("link_ok")
    return links.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), (F.count(F.lit(1)) - good).alias("broken"),
                                    (good / F.count(F.lit(1)) * 100).alias("integrity"))


def encrypt(c: Column, key: str) -> Column:
    """Base64 of AES-GCM with a fresh nonce per row."""
    return F.base64(F.aes_encrypt(c.cast("string"), F.lit(key), F.lit("GCM")))


def decrypt(c: Column, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(c), F.lit(key), F.lit("GCM")).cast("string")
