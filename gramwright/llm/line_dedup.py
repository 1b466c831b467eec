"""Line dedup against levelled sorted runs of line hashes.

A store keeps every line hash seen so far in runs: tables bucketed and sorted
by hash, so that a new batch merge-joins them without moving them. A batch
finds which of its hashes some run has, drops those lines, and adds the hashes
that are new to all as a run of its own on level 0. FANOUT runs of a level are
compacted into one of the next. Runs never share a hash. Documents go through
in batches of ascending doc_id, which makes the first holder of a line the
smallest. Only DataFrame functions are used.

A hash is 96 bits: two unlike lines of a corpus of 10^12 lines meet with a
chance of about 10^-5.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Key's least length in code points.
LEAST = 10
BATCHES = 4
FANOUT = 3

# What is stripped from both ends of a line, and the letters made small.
BLANKS = "\t\n\x0b\x0c\r "
LARGE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = "abcdefghijklmnopqrstuvwxyz"

HASH = ["h1", "h2"]


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def line_rows(rows: DataFrame) -> DataFrame:
    """doc, text_hash, pos, h1, h2 of the lines whose key is long enough; rows
    has doc and text."""
    lines = rows.select("doc", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(F.translate("text", LARGE, SMALL), "\n")).alias("pos", "line"))
    keyed = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.length("line") >= LEAST)
    return keyed.select("doc", "text_hash", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


class LineStore:
    """Levelled runs of line hashes, as bucketed tables of the session's catalog.

    A run holds h1, h2 and `seen`; rows with seen set are the batch's own notes
    on hashes of older runs and are no part of the run. A store given the name
    of an earlier one goes on with its runs: their levels are in their names.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT, name: str | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = name or f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.made = 0
        for table in sorted(t.name for t in spark.catalog.listTables(pattern=f"{self.name}_*")) if name else []:
            level, number = (int(x) for x in table.removeprefix(f"{self.name}_").split("_"))
            self.levels += [[] for _ in range(level + 1 - len(self.levels))]
            self.levels[level].append(table)
            self.made = max(self.made, number)

    def _save(self, df: DataFrame, level: int) -> str:
        self.made += 1
        table = f"{self.name}_{level}_{self.made}"
        df.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH).format("parquet").saveAsTable(table)
        return table

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t).where("not seen") for level in self.levels for t in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Takes in a batch (line_rows); returns its rows to drop."""
        keys = lines.groupBy(*HASH).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        marks = []
        for k, run in enumerate(self.runs()):
            marks.append(F.coalesce(F.col(f"in{k}"), F.lit(False)))
            keys = keys.join(run.select(*HASH, F.lit(True).alias(f"in{k}")), HASH, "left")
        seen = reduce(lambda a, b: a | b, marks, F.lit(False))
        table = self._save(keys.select(*HASH, "first", "last", seen.alias("seen")), 0)
        self.levels[0].append(table)
        # out of the buckets: a join of two plain tables can be split at a line that is everywhere
        repeated = common.materialise(self.spark.table(table).where("seen or last > first").select(*HASH, "first", "seen"), "repeated-lines")
        self._compact()
        return lines.join(repeated, HASH).where("seen or doc > first").select("doc", "text_hash", "pos")

    def _compact(self) -> None:
        """FANOUT runs of a level become one of the next, and go."""
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = reduce(DataFrame.unionByName, [self.spark.table(t).where("not seen").select(*HASH, "seen") for t in level])
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._save(merged, k + 1))
                self._drop(level)

    def _drop(self, level: list[str]) -> None:
        for table in level:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        level.clear()

    def drop(self) -> None:
        """Deletes all runs."""
        for level in self.levels:
            self._drop(level)


def batches(rows: DataFrame, n: int) -> list[DataFrame]:
    """Parts of about equal size by ascending doc; the bounds are told on doc_id
    itself, so that the scan can skip what is outside."""
    cuts = rows.agg(F.percentile_approx("doc", [k / n for k in range(1, n)], 1000).alias("cuts")).first()["cuts"] or []
    edges = [None, *sorted({c for c in cuts if c != common.NO_ID}), None]
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = rows
        if lo is not None:
            part = part.where((F.col("doc_id") > lo) | F.col("doc_id").isNull())
        if hi is not None:
            part = part.where(F.col("doc_id") <= hi)
        out.append(part)
    return out


def drop_lines(documents: DataFrame, n_batches: int = BATCHES, text: bool = True) -> DataFrame:
    """Every row of documents with its columns as `row`, n_lines, n_dropped and
    kept, the text without dropped lines.

    A key of at least LEAST code points that two or more documents hold loses
    its lines in all but the smallest doc_id. Null or empty texts are one empty
    line. Rows without a doc_id are one document after all others; rows with
    the same doc_id are one document for this rule, and each keeps its own
    lines. Empty tables give no rows; no input column can clash with the rest.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", common.doc_key().alias("doc"), text_of().alias("text"))
    store = LineStore(spark)
    try:
        parts = [common.materialise(store.add(line_rows(part)), "dropped-lines") for part in batches(rows, n_batches)]
    finally:
        store.drop()
    dropped = reduce(DataFrame.union, parts).groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    whole = documents.select(common.doc_key().alias("doc"), text_of().alias("text"), F.struct("*").alias("row")) if text else rows.withColumn("row", F.struct("doc"))
    joined = whole.withColumn("text_hash", F.xxhash64("text")).join(dropped, ["doc", "text_hash"], "left")
    lines = F.split("text", "\n")
    # the stretches of lines between those dropped
    kept = F.expr("""flatten(transform(sequence(0, size(at)), i ->
        slice(lines, if(i = 0, 0, at[i - 1] + 1) + 1, if(i = size(at), size(lines), at[i]) - if(i = 0, 0, at[i - 1] + 1))))""")
    out = joined.withColumn("lines", lines)
    return out.select(
        "row", "doc", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("at").isNull(), 0).otherwise(F.size("at")).cast("long").alias("n_dropped"),
        F.when(F.col("at").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    found = drop_lines(common.table(spark, sf_dir, "documents"), text=False)
    return found.select(common.id_from_key("doc").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH split_lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), each_line AS (
  SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM split_lines
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM each_line
), holders AS (
  SELECT k, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 10 GROUP BY k
), judged AS (
  SELECT doc_id, pos, line, coalesce(doc_id > first_doc, false) AS dropped FROM keyed LEFT JOIN holders USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
