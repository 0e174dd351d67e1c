"""From raw documents to token ids: quality, lines, near-duplicates, mixture, tokens.

Each stage takes all that its predecessor kept, as a written table, and its decisions take effect. All but the last return
the columns of documents, whichever they are. In every stage a null text counts as an empty one but stays null, rows without
doc_id and rows that share one are documents of their own, and an empty table gives an empty one.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import line_dedup, mixing, quality, sentencepiece_codec, simhash_dedup
from quirefold.llm.common import saved, scratch, table
from quirefold.llm.queries import model_bytes

#: Documents whose likelihood of label 1 is below this are rejected.
REJECT_BELOW = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The quality classifier: documents that it rejects go. Empty texts have the score of a text without features."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out("doc_id"))
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.where(F.col("score") >= REJECT_BELOW).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line deduplication: lines seen before are cut out; n_chars follows the text. Of equal lines the one of the smallest
    doc_id, then of the smallest number, stays; rows without doc_id keep all lines."""
    cut = line_dedup.line_dedup(docs)
    return cut.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-deduplication: of each group the document with the smallest doc_id stays, of repeated rows one. Texts
    without words are one group; rows without doc_id all stay."""
    return simhash_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: one row for each copy that the mix takes, in order of training position. A null source is a
    source; a text without words is taken once where its turn comes."""
    return mixing.training_order(mixing.mix(docs), docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: ids and their number in place of text and n_chars; other columns are kept. An empty text is
    one piece, the mark."""
    encoded = sentencepiece_codec.encode(docs.drop("n_chars"), model_bytes())
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", keep_good), ("line_dedup", drop_lines), ("simhash_dedup", drop_near_copies), ("mixing", mix_sources), ("sentencepiece", tokenize)]

#: SQL expresses neither the classifier nor the segmentation; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again. What a stage wrote besides goes with it, and all tables
    but the last with the last."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark, STAGES[-2][0]):
        for name, stage in STAGES[:-1]:
            with scratch(spark, name):
                docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
