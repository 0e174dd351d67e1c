"""Fair claims, releases and demand over queues, as relational steps on their tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fair_claim(queue: DataFrame, served: DataFrame, busy: DataFrame | None = None, accounts: DataFrame | None = None) -> DataFrame:
    """The one pointer to serve next, of the account served longest ago.

    queue: pos (oldest first), account_id, novel_id, chapter_index, priority, enrichment; served: account_id, last_seq;
    busy: account_id of those with a job at work, which get no other; accounts: account_id, mode, focus (a novel): a paused
    account gets nothing, a focused one its novel only. Accounts never served go first, with 0; ties go to the account with
    the oldest pointer. Within the account the best rank (4 for the focus, 2 for priority, 1 for no enrichment) names the
    novel of its oldest pointer, of which the lowest chapter of that rank is served. Every step keeps one row by an
    aggregate, so nothing is sorted as a whole.
    """
    if busy is not None:
        queue = queue.join(busy.select("account_id").distinct(), "account_id", "left_anti")
    focus = F.lit(False)
    if accounts is not None:
        queue = queue.join(accounts, "account_id")
        focus = F.coalesce(F.col("novel_id") == F.col("focus"), F.lit(False))
        queue = queue.where((F.col("mode") != "paused") & ((F.col("mode") != "focused") | focus))
    ranked = queue.withColumn("rank", 4 * focus.cast("int") + 2 * F.col("priority").cast("int") + (~F.col("enrichment")).cast("int"))
    oldest = ranked.groupBy("account_id").agg(F.min("pos").alias("oldest")).join(served, "account_id", "left")
    account = oldest.agg(F.min(F.struct(F.coalesce("last_seq", F.lit(0)), "oldest", "account_id")).alias("a")).select(F.col("a.account_id").alias("account_id"))
    own = ranked.join(F.broadcast(account), "account_id")  # one row
    novel = own.agg(F.max(F.struct("rank", -F.col("pos"), "novel_id")).alias("n")).select("n.rank", "n.novel_id")
    same = own.join(F.broadcast(novel), ["rank", "novel_id"])  # one row
    return same.agg(F.min(F.struct("chapter_index", "pos", "account_id", "novel_id")).alias("s")).select("s.account_id", "s.novel_id", "s.chapter_index", "s.pos")


def capped_claims(waiting: DataFrame, running: DataFrame, served: DataFrame, most: int = 3) -> DataFrame:
    """Jobs to start: at most `most` run at once, one an account; accounts served longest ago first, each with its oldest job.

    waiting: job_id, account_id; running: account_id, one row a job; served: account_id, last_seq.
    """
    first = waiting.groupBy("account_id").agg(F.min("job_id").alias("job_id")).join(running, "account_id", "left_anti")
    free = running.agg(F.greatest(F.lit(0), most - F.count("*")).alias("free"))
    order = first.join(served, "account_id", "left").orderBy(F.coalesce("last_seq", F.lit(-1)), "job_id").limit(most)
    n = F.row_number().over(W.orderBy(F.coalesce("last_seq", F.lit(-1)), "job_id"))  # `most` rows
    return order.withColumn("n", n).join(F.broadcast(free), F.col("n") <= F.col("free")).select("job_id", "account_id")


def released(claims: DataFrame) -> DataFrame:
    """The pointers that claims (novel_id, chapter_index, outcome, priority, enrichment) put back.

    done puts none back, retry the same one, enrich one of low priority that is for enrichment.
    """
    low = F.col("outcome") == "enrich"
    return claims.where("outcome in ('retry', 'enrich')").select("novel_id", "chapter_index", (F.col("priority") & ~low).alias("priority"), (F.col("enrichment") | low).alias("enrichment"))


def prioritised(queue: DataFrame, wanted: DataFrame, processing: DataFrame) -> DataFrame:
    """The queue with the wanted pointers once, in front with priority, unless they are processed now.

    queue: pos, novel_id, chapter_index, priority. The new ones share the place before the first; a claim orders them by chapter.
    """
    keys = ["novel_id", "chapter_index"]
    free = wanted.select(*keys).distinct().join(processing, keys, "left_anti")
    top = queue.agg(F.min("pos")).first()[0] or 0
    front = free.select(F.lit(top - 1).cast("long").alias("pos"), *keys, F.lit(True).alias("priority"))
    return queue.select("pos", *keys, "priority").join(free, keys, "left_anti").select("pos", *keys, "priority").unionByName(front)


def fenced(beats: DataFrame, leases: DataFrame, now: float, timeout: float) -> DataFrame:
    """leases (key, claimed_at) with the last beat that carries their token and whether they live; other beats count for nothing."""
    last = beats.join(leases, ["key", "claimed_at"], "left_semi").groupBy("key", "claimed_at").agg(F.max("ts").alias("last"))
    seen = F.coalesce("last", "claimed_at")
    return leases.join(last, ["key", "claimed_at"], "left").select("key", "claimed_at", seen.alias("last"), (F.lit(now) - seen < timeout).alias("live"))


def demand(progress: DataFrame, chapters: DataFrame, queued: DataFrame, lookahead: int) -> DataFrame:
    """Chapters to queue: those not done and not queued within `lookahead` after any reader of the novel."""
    due = progress.select("novel_id", F.explode(F.sequence(F.col("current_chapter") + 1, F.col("current_chapter") + lookahead)).alias("chapter_index")).distinct()
    keys = ["novel_id", "chapter_index"]
    return due.join(chapters.where("status != 'done'"), keys, "left_semi").join(queued, keys, "left_anti")


def paused(ahead: Column, window: Column, depth: Column, limit: Column) -> Column:
    """Whether fetching waits: the window of chapters ahead is full, or the queue has reached a limit where one is set."""
    return (ahead >= window) | F.coalesce(depth >= limit, F.lit(False))
