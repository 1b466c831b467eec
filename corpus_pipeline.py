"""A training corpus from documents: toxicity, line dedup, near-dedup,
benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and judges its own input; each but the
last returns the columns of docs. Each begins with executors' heaps given back.
run() writes each stage's rows as Parquet in the shared folder and reads them
again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramwright.llm import common, decontaminate, line_dedup, near_dedup, packing, toxicity
from gramwright.llm.tokens import vocabulary

#: Words that a worker remembers while packing: it also has the other stages to hold.
WORDS = 150_000

#: Least similarity of near copies in the corpus, in hundredths; op1's own is near_dedup.LINK.
NEAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at THRESHOLD or more go. The machine is trained on the
    labelled rows of docs that are not held out. Null and empty texts get the
    score of a text without terms; rows are judged one by one, whether their
    doc_id is null or repeated; without labels, or with one class alone, all get
    the same score, the share of toxic labels, and an empty table stays empty."""
    common.give_back_heaps(spark)
    machine = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    name = "toxicity_score"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, machine, name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; n_chars follows the text. Null and
    empty texts are one empty line and stay as they are. Rows with the same doc_id
    are one document and keep what they share; those without a doc_id are one
    after all others. An empty table stays empty."""
    common.give_back_heaps(spark)
    found = line_dedup.drop_lines(docs)
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each group linked at NEAR stays; rows
    without a doc_id come after all others. Rows are linked one by one, by a hash
    of doc_id and text: what a row's doc_id shares with other rows does not matter,
    and of rows equal in both one stays. Texts without words, null or not, are like
    no other and stay; an empty table stays empty."""
    common.give_back_heaps(spark)
    name = "row_key"
    while name in docs.columns:
        name += "_"
    text = F.col("text").cast("string")
    keyed = docs.withColumn(name, F.xxhash64(common.doc_key(), F.col("doc_id").isNull(), F.coalesce(text, F.lit("")), text.isNull()))
    linked = common.materialise(near_dedup.link_components(keyed.select(F.col(name).alias("doc_id"), "text"), NEAR), "near-rows")
    n = linked.count()
    others = linked.where("doc <> component").select("doc", "component").distinct()
    members = common.materialise(others.unionByName(others.select(F.col("component").alias("doc"), "component").distinct()), "near-copies", rows=n)
    ids = keyed.select(F.col(name).alias("doc"), common.doc_key().alias("id"))
    heads = members.join(ids, "doc").groupBy("component").agg(F.min(F.struct("id", "doc"))["doc"].alias("doc"))
    gone = common.materialise(members.select("doc").join(heads.select("doc"), "doc", "left_anti"), "near-gone", rows=n)
    twice = linked.where("n_shingles > 0").groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1").select("doc")
    twice = common.materialise(twice, "equal-rows", rows=n)
    rows = keyed.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(name).alias("doc"))
    rows = common.flagged(common.flagged(rows, "doc", gone, name="may_go"), "doc", twice, name="may_equal")
    # most rows stay where they are; the few that maps point at are joined
    rest = rows.where("may_go or may_equal").join(gone, "doc", "left_anti").join(twice.withColumn("equal", F.lit(0).cast("long")), "doc", "left")
    rest = rest.withColumn("tie", F.coalesce("equal", F.monotonically_increasing_id() + 1)).dropDuplicates(["doc", "tie"])
    return rows.where("not may_go and not may_equal").select("row.*").unionByName(rest.select("row.*").hint("rebalance"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of any benchmark item go. One item is enough here;
    the two items of LEAST_ITEMS only make op8's column `contaminated`. Texts
    without words stay, and all do if the benchmark is empty. Rows are judged one
    by one, whatever their doc_id; an empty table stays empty."""
    common.give_back_heaps(spark)
    return decontaminate.remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"), least_items=1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences, with their ids (little-endian u32). Null
    and empty texts give the end id alone; rows are packed one by one, whatever
    their doc_id; an empty table gives no pieces."""
    common.give_back_heaps(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), with_ids=True, memory=WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: Training, scoring and tokenizing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
