"""An inventory derived from the documents table: a row a document, the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COLUMNS, LINK, SECOND

#: When the first document was written, in seconds.
EPOCH = 1_700_000_000


def entries(spark: SparkSession, sf_dir: str, kind: str = "main") -> DataFrame:
    """main leaves out each 7th document; cache has each 3rd with other content; scan leaves out each 5th and has each 13th a byte longer
    and a minute younger; all has every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    n = F.col("doc_id")
    docs = {"all": docs, "main": docs.filter(n % 7 != 0), "cache": docs.filter(n % 3 == 0), "scan": docs.filter(n % 5 != 0)}[kind]
    changed = F.lit(False) if kind in ("all", "main") else n % 13 == 0 if kind == "scan" else F.lit(True)
    more = F.when(changed, 1).otherwise(0)
    text = F.when(changed, F.concat("text", F.lit("x"))).otherwise(F.col("text")) if kind == "cache" else F.col("text")
    mtime = (F.lit(EPOCH) + n * 3600 + more * 60) * SECOND + F.pmod(n * 7919, F.lit(SECOND))
    columns = {
        "path": F.concat("source", F.lit("/"), "lang", F.lit("/"), F.lpad(n.cast("string"), 8, "0"), F.lit(".txt")),
        "file_size": F.octet_length("text") + more,
        "mode": F.element_at(F.array(*map(F.lit, (0o644, 0o600, 0o755))), (n % 3 + 1).cast("int")) + F.when(n % 29 == 0, F.lit(LINK)).otherwise(F.lit(0)),
        "uid": 1000 + n % 3,
        "gid": 100 + n % 2,
        "dev": F.lit(1),
        "ino": n + 100,
        "ctime_ns": mtime + 60 * SECOND,
        "mtime_ns": mtime,
        "is_deleted": n % 11 == 0,
        "hash_type": F.when(n % 17 == 0, 0).otherwise(2),
        "hash": F.sha2(text, 256),
        "context": F.lit("main" if kind == "all" else kind),
    }
    kinds = {"path": "string", "is_deleted": "boolean", "hash": "string", "context": "string"}
    return docs.select(*[columns[c].cast(kinds.get(c, "long")).alias(c) for c in COLUMNS])


def defective(df: DataFrame) -> DataFrame:
    """Rows with injected defects, by their inode number, for the validation rules."""
    n = F.col("ino") - 100
    return (
        df.withColumn("hash", F.when(n % 19 == 0, F.repeat(F.lit("0"), 64)).when(n % 23 == 0, "").when(n % 31 == 0, F.concat(F.lit("zz"), F.substring("hash", 3, 62))).otherwise(F.col("hash")))
        .withColumn("file_size", F.when(n % 37 == 0, F.lit((1 << 62) + 1)).when(n % 59 == 0, 0).otherwise(F.col("file_size")))
        .withColumn("path", F.when(n % 41 == 0, "").otherwise(F.col("path")))
        .withColumn("ctime_ns", F.when(n % 43 == 0, F.lit(-1)).otherwise(F.col("ctime_ns")))
        .withColumn("mtime_ns", F.when(n % 47 == 0, F.lit(4_000_000_000 * SECOND)).otherwise(F.col("mtime_ns")))
    )


#: The same rows in SQL, as the body of a CTE; {where}, {more} and {text} stand for what differs by kind.
SQL = f"""
  SELECT source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS path,
         CAST(strlen(text) + {{more}} AS BIGINT) AS file_size,
         CAST([420, 384, 493][1 + doc_id % 3] + CASE WHEN doc_id % 29 = 0 THEN {LINK} ELSE 0 END AS BIGINT) AS mode,
         1000 + doc_id % 3 AS uid, 100 + doc_id % 2 AS gid, 1::BIGINT AS dev, doc_id + 100 AS ino,
         ({EPOCH} + doc_id * 3600 + {{more}} * 60 + 60) * {SECOND} + (doc_id * 7919) % {SECOND} AS ctime_ns,
         ({EPOCH} + doc_id * 3600 + {{more}} * 60) * {SECOND} + (doc_id * 7919) % {SECOND} AS mtime_ns,
         doc_id % 11 = 0 AS is_deleted, CAST(CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 2 END AS BIGINT) AS hash_type,
         sha256({{text}}) AS hash, '{{context}}' AS context, doc_id
  FROM documents WHERE {{where}}
"""
ALL_SQL = SQL.format(more="0", text="text", where="true", context="main")
MAIN_SQL = SQL.format(more="0", text="text", where="doc_id % 7 <> 0", context="main")
CACHE_SQL = SQL.format(more="1", text="text || 'x'", where="doc_id % 3 = 0", context="cache")
SCAN_SQL = SQL.format(more="CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END", text="text", where="doc_id % 5 <> 0", context="scan")
