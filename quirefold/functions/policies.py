"""Row policies: a second layer of predicates that no query over the views can leave out.

Each table is registered as a view with the predicates of its policies, all of which must hold. They read session
variables, which are unset at first: then nothing is seen. The views hold whatever a query itself filters.
"""

from pyspark.sql import DataFrame, SparkSession

#: The session variables that policies read, with their types; all null until set.
VARIABLES = {"reader_novel": "STRING", "reader_chapter": "INT", "reader_account": "STRING"}
#: Predicates by name. A comparison with an unset variable is null, which lets no row through.
POLICIES = {
    "novel": "novel_id = reader_novel",
    "chapter": "chapter_index <= coalesce(reader_chapter, -1)",
    "account": "owner_id = reader_account",
    "reviewed": "coalesce(review_state, 'passed') <> 'held'",
}


def register(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]]) -> None:
    """Registers each table (frame and names of its policies) as a view; a table without policies shows nothing."""
    for name, kind in VARIABLES.items():
        spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {kind} DEFAULT NULL")
    for name, (df, policies) in tables.items():
        df.createOrReplaceTempView(f"_all_{name}")
        held = " AND ".join(f"({POLICIES[p]})" for p in policies) or "false"
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT * FROM _all_{name} WHERE {held}")


def read_as(spark: SparkSession, novel: str | None = None, chapter: int | None = None, account: str | None = None) -> None:
    """Sets who reads in this session, for queries from now on; what is not given is unset."""
    for name, value in (("reader_novel", novel), ("reader_chapter", chapter), ("reader_account", account)):
        spark.sql(f"SET VARIABLE {name} = :v", args={"v": value})
