"""What a confirmed or approved spelling asks of the chapters that render its term."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.glossary import respell_action


def confirmed(corrections: DataFrame, glossary: DataFrame) -> DataFrame:
    """corrections (novel_id, source_term, target_term, at_chapter) that change something, with the new version of the term.

    Targets are trimmed; blank ones and ones of over 160 characters are left out, as are those that the glossary (novel_id,
    source_term, target_term, version, deleted) has already: a repeat asks for nothing again.
    """
    told = corrections.withColumn("target_term", F.regexp_replace("target_term", r"(?U)^\s+|\s+$", "")).where(F.length("target_term").between(1, 160) & (F.col("at_chapter") >= 0))
    have = glossary.select("novel_id", "source_term", F.col("target_term").alias("_target"), F.col("deleted").alias("_deleted"), "version")
    same = F.coalesce((F.col("_target") == F.col("target_term")) & ~F.col("_deleted"), F.lit(False))
    return told.join(have, ["novel_id", "source_term"], "left").where(~same).withColumn("version", F.coalesce("version", F.lit(0)) + 1).drop("_target", "_deleted")


def messages(changes: DataFrame, primed: DataFrame, occurrences: DataFrame, chapters: DataFrame) -> DataFrame:
    """novel_id, chapter_index, source_term, target_term and action of every chapter that a changed spelling touches.

    changes: novel_id, source_term, target_term. primed: how each term was spelled when chapters were translated (novel_id,
    source_term, spelling). occurrences: novel_id, chapter_index, source_term. chapters: novel_id, chapter_index, translated.
    A chapter that has the spelling already gets no message. Terms meet chapters by their occurrences, no others are read.
    """
    touched = changes.join(occurrences.select("novel_id", "source_term", "chapter_index").distinct(), ["novel_id", "source_term"])
    touched = touched.join(primed.select("novel_id", "source_term", "spelling"), ["novel_id", "source_term"], "left").join(chapters.select("novel_id", "chapter_index", "translated"), ["novel_id", "chapter_index"])
    action = respell_action(F.col("translated"), F.col("spelling"), F.col("target_term"))
    return touched.withColumn("action", action).where("action <> 'none'").select("novel_id", "chapter_index", "source_term", "target_term", "action")
