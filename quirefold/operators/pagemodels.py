"""What readers see of facts: pages of characters and subjects, rankings, and the pace of requests."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds of relationships by the heading of a page, kinds that hold both ways, and those that turn around.
HEADINGS = {
    "Family": ("brother", "child", "daughter", "family", "father", "grandfather", "granddaughter", "grandmother", "grandson", "mother", "parent", "sibling", "sister", "son"),
    "Lovers": ("lover",), "Friends": ("friend",), "Enemies": ("enemy",), "Superiors": ("superior",), "Subordinates": ("subordinate",),
}
SYMMETRIC = ("brother", "enemy", "family", "friend", "lover", "sibling", "sister")
INVERSE = {"subordinate": "superior", "superior": "subordinate"}
SECTIONS = {"ability": "Abilities", "item": "Possessions", "affiliation": "Affiliations", "status": "Status"}
TIES = {"organization": ("affiliation", "Members"), "item": ("item", "Held by")}
#: What the way a name was found says about the role of who bears it.
ROLES = {"pinyin": "chinese_person", "restored_name": "foreign_person", "semantic_translation": "semantic_term", "translated_title": "personal_title"}


def _of(names: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)


def other_is(subject: str) -> Column:
    """other and kind: who the other one of a relationship (kind, subjects) is to the subject; null if it does not tell."""
    first, second, kind = F.get("subjects", F.lit(0)), F.get("subjects", F.lit(1)), F.col("kind")
    turned = F.when(second == subject, kind).when(first == subject, F.coalesce(_of(INVERSE, kind), F.when(kind.isin(*SYMMETRIC), kind)))
    told = F.coalesce(first != second, F.lit(False)) & turned.isNotNull()
    return F.when(told, F.struct(F.when(second == subject, first).otherwise(second).alias("other"), turned.alias("kind")))


def wiki_parts(facts: DataFrame, subject: str) -> DataFrame:
    """The facts (category, kind, subjects) that name a subject, with part: where each stands on the subject's page.

    A fact is about the first it names. Events and places are everyone's history; others that only mention the subject
    stand apart. A relationship stands under a heading for what the other one is, or with the rest if that is not told.
    """
    heading = _of({kind: name for name, kinds in HEADINGS.items() for kind in kinds}, other_is(subject)["kind"])
    category, about = F.col("category"), F.get("subjects", F.lit(0)) == subject
    part = F.when(category.isin("event", "place"), "history").when((category != "relationship") & ~about, "mentions").when(category.isin("intro", "alias"), category)
    part = part.when(category == "relationship", F.coalesce(heading, F.lit("more"))).otherwise(_of(SECTIONS, category))
    return facts.where(F.array_contains("subjects", subject)).withColumn("part", part)


def subject_parts(facts: DataFrame, subject: str, kind: str) -> DataFrame:
    """The same for an organization, a place or an item: facts about others that name it are its history, except those
    that say who belongs to it or holds it.
    """
    tie, heading = TIES.get(kind, ("", ""))
    category, about = F.col("category"), F.get("subjects", F.lit(0)) == subject
    part = F.when((category == "event") | (~about & (category != tie)), "history").when(~about, heading).when(category.isin("intro", "alias"), category).otherwise("details")
    return facts.where(F.array_contains("subjects", subject)).withColumn("part", part)


def role_of(method: Column, fallback: Column) -> Column:
    return F.coalesce(_of(ROLES, method), F.nullif(fallback, F.lit("")), F.lit("chinese_person"))


def reviewed(rows: DataFrame) -> DataFrame:
    """Rows that passed their review."""
    return rows.where("review_state = 'passed'")


def mention_ranking(facts: DataFrame, people: DataFrame) -> DataFrame:
    """name and n, the number of facts (fact_id, text) that name it as a whole word outside longer names that hold it.

    people: name. A name and a fact meet by the name's rarest word among the facts, and only those that do are read.
    """
    from quirefold.functions.glossary import whole_word

    words = lambda x: F.array_distinct(F.filter(F.split(x, r"(?U)[^\w-]+"), lambda w: w != ""))
    own = people.select("name").distinct()
    parts = own.select("name", F.explode(words(F.col("name"))).alias("w"))
    said = facts.select("fact_id", F.explode(words(F.col("text"))).alias("w")).join(parts.select("w").distinct(), "w", "left_semi")
    common = said.groupBy("w").agg(F.count("*").alias("df"))
    rarest = parts.join(common, "w", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))["w"].alias("w"))
    # names within others meet in the same way, by the rarest word
    holds = rarest.join(parts.select(F.col("name").alias("longer"), "w"), "w").where("name != longer").where(F.regexp_like("longer", whole_word(F.col("name"))))
    shields = rarest.join(holds.groupBy("name").agg(F.array_join(F.collect_set(whole_word(F.col("longer"))), "|").alias("shield")), "name", "left")
    met = said.join(shields, "w").select("fact_id", "name", "shield").join(facts.select("fact_id", "text"), "fact_id")
    bare = F.when(F.col("shield").isNotNull(), F.regexp_replace("text", F.col("shield"), F.lit(" "))).otherwise(F.col("text"))
    hits = met.where(F.regexp_like(bare, whole_word(F.col("name")))).groupBy("name").agg(F.count_distinct("fact_id").alias("n"))
    return own.join(hits, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def paced(requests: DataFrame, gap: float, floors: DataFrame | None = None) -> DataFrame:
    """requests (host, ts and others) with due: when each may start, `gap` seconds after the one before to its host, or as
    many as the host asks for (floors: host, delay), if that is more. Without a fold: what is due is the latest of ts - n
    gaps so far, and n gaps.
    """
    if floors is not None:
        requests = requests.join(floors, "host", "left").withColumn("_gap", F.greatest(F.lit(gap), F.coalesce("delay", F.lit(0)))).drop("delay")
    else:
        requests = requests.withColumn("_gap", F.lit(gap))
    order = W.partitionBy("host").orderBy("ts", *[c for c in requests.columns if c not in ("host", "ts", "_gap")])
    n = F.row_number().over(order)
    rows = requests.withColumn("_n", n)
    latest = F.max(F.col("ts") - F.col("_gap") * F.col("_n")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("due", latest + F.col("_gap") * F.col("_n")).drop("_gap", "_n")
