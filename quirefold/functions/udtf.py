"""Table functions for SQL: chunks of a text, and mentions in the texts of a partition.

    SELECT d.doc_id, c.* FROM docs d, LATERAL chunk_text(d.text, d.lang, 400) c
    SELECT * FROM scan_mentions(TABLE(rows) PARTITION BY novel_id ORDER BY text IS NOT NULL)
"""

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from quirefold.operators.chunks import chunk
from quirefold.operators.scan import Aliases, spans

CHUNK = "ordinal int, chunk string, start int, end int"
MENTION = "novel_id string, doc_id bigint, alias_id string, byte_start int, byte_end int, char_start int, char_end int"


class ChunkText:
    """The chunks of a text by a budget of tokens; none of a null text."""

    def eval(self, text: str, lang: str, budget: int) -> Iterator[tuple]:
        for c in chunk(text or "", lang, budget):
            yield c["ordinal"], c["text"], c["start"], c["end"]


class ScanMentions:
    """Mentions in the texts of one partition, of the aliases of that partition.

    Rows: novel_id, doc_id, text, lang, and alias_id and surface. Rows with a surface are aliases and come first; the others
    are texts, which are searched one by one, so a task holds the aliases of a partition and one text.
    """

    def __init__(self):
        self.rows: list[tuple[str, str]] = []
        self.known: Aliases | None = None

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["text"] is None:
            if row["surface"]:
                self.rows.append((str(row["alias_id"]), row["surface"]))
                self.known = None
            return
        self.known = self.known or Aliases(tuple(self.rows))
        out: dict[str, list] = {k: [] for k in ("alias_id", "byte_start", "byte_end", "char_start", "char_end")}
        spans(row["text"], row["lang"], self.known, out)
        for found in zip(*out.values(), strict=True):
            yield row["novel_id"], row["doc_id"], *found


def register(spark: SparkSession) -> None:
    """Makes chunk_text and scan_mentions known to the session's SQL."""
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType=CHUNK))
    spark.udtf.register("scan_mentions", udtf(ScanMentions, returnType=MENTION))
