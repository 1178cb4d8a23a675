"""The link table: counts, lists, retries, canonical insertion, state folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palmleaf.functions.text import contains_fold, epoch
from palmleaf.functions.titles import error_class, retryable
from palmleaf.functions.urls import host, library_key

STATUSES = ("scraped", "failed", "pending")


def count_by_status(links: DataFrame) -> DataFrame:
    return links.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def count_by_source(links: DataFrame) -> DataFrame:
    """One row per source: all links, those of each status, and the percentage that is scraped."""
    part = {s: F.count_if(F.col("status") == s).alias(s) for s in STATUSES}
    out = links.groupBy("source").agg(F.count(F.lit(1)).alias("links"), *part.values())
    return out.withColumn("percent", F.when(F.col("links") == 0, 0).otherwise(F.floor(100.0 * F.col("scraped") / F.col("links") + 0.5)).cast("long"))


def listed(links: DataFrame, status: str = "", source: str = "", wanted: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of links, newest discovery first; an unknown status filters nothing."""
    df = links
    if status in STATUSES:
        df = df.where(F.col("status") == status)
    if source:
        df = df.where(F.col("source") == source)
    if wanted:
        df = df.where(contains_fold(F.col("title"), wanted) | contains_fold(F.col("url"), wanted))
    return df.orderBy(epoch(F.col("discovered_at")).desc(), F.col("link_id").desc()).offset(offset).limit(limit)


def failed_retryable(links: DataFrame) -> DataFrame:
    return links.where((F.col("status") == "failed") & retryable(F.col("error")))


def requeued(links: DataFrame) -> DataFrame:
    """The table after a retry of all failures that may pass."""
    again = (F.col("status") == "failed") & retryable(F.col("error"))
    return links.withColumn("error", F.when(again, "").otherwise(F.col("error"))).withColumn("status", F.when(again, "pending").otherwise(F.col("status")))


def first_of_each(links: DataFrame) -> DataFrame:
    """Insert-or-ignore on the canonical url: the first row of each key by id.

    An aggregate, not a window: it combines before the shuffle, so a hot key costs no more than any other.
    """
    df = links.where("url is not null").withColumn("key", library_key(F.col("url")))
    return df.groupBy("key").agg(F.min_by("url", "link_id").alias("url"), F.min("link_id").alias("link_id"), F.count(F.lit(1)).alias("n"))


def new_against(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links whose key is not in ``known`` (a column ``key``) yet, once each."""
    return first_of_each(links).join(known.select("key").distinct(), "key", "left_anti")


def with_error_class(links: DataFrame) -> DataFrame:
    return links.withColumn("error_class", error_class(F.col("error")))


def hosts(links: DataFrame) -> DataFrame:
    return links.where("url is not null").groupBy(host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def delays(links: DataFrame, profile: DataFrame, base_ms: int = 500) -> DataFrame:
    """(host, delay_ms): the larger of the base delay and the host's own; ``profile`` (host, delay_ms) is a setting."""
    own = F.broadcast(profile.select("host", F.col("delay_ms").alias("_d")).limit(10_000))
    return hosts(links).join(own, "host", "left").select("host", F.greatest(F.lit(base_ms), F.coalesce("_d", F.lit(0))).cast("long").alias("delay_ms"))


def fold_journal(journal: DataFrame) -> DataFrame:
    """(url, status, error, retries): success is scraped, failed is failed, all else pending; the
    error is that of the last record; retries counts the failures. Order is seq; NULL states are skipped.
    """
    df = journal.where("url is not null and state is not null and state.status is not null")
    out = df.groupBy("url").agg(F.max_by(F.struct("state.status", "state.error"), "seq").alias("_last"), F.count_if(F.col("state.status") == "failed").alias("retries"))
    status = F.when(F.col("_last.status") == "success", "scraped").when(F.col("_last.status") == "failed", "failed").otherwise("pending")
    return out.select("url", status.alias("status"), F.coalesce("_last.error", F.lit("")).alias("error"), "retries")


def last_states(journal: DataFrame) -> DataFrame:
    """Journal replay: the last record of each url wins, whatever it says."""
    return journal.where("url is not null").groupBy("url").agg(F.max("seq").alias("seq"), F.max_by(F.coalesce("state.status", F.lit("")), "seq").alias("status"))


def reconcile(manifest: DataFrame, journal: DataFrame, manifest_seq: int) -> DataFrame:
    """A snapshot (url, status, error) and the journal after it: the snapshot counts no failure
    but a first-seen failed one, and records up to ``manifest_seq`` are part of it."""
    snap = manifest.where("url is not null").select("url", F.lit(-1).cast("long").alias("seq"), "status", "error", F.lit(True).alias("snap"))
    later = journal.where(f"url is not null and state.status is not null and seq > {int(manifest_seq)}").select("url", "seq", "state.status", "state.error", F.lit(False).alias("snap"))
    both = snap.unionByName(later)
    out = both.groupBy("url").agg(
        F.max_by(F.struct("status", "error"), "seq").alias("_last"),
        F.count_if((F.col("status") == "failed") & ~F.col("snap")).alias("_n"),
        F.max(((F.col("status") == "failed") & F.col("snap")).cast("int")).alias("_s"),
    )
    status = F.when(F.col("_last.status") == "success", "scraped").when(F.col("_last.status") == "failed", "failed").otherwise("pending")
    return out.select("url", status.alias("status"), F.coalesce("_last.error", F.lit("")).alias("error"), (F.col("_n") + F.col("_s")).alias("retries"))


def applied(links: DataFrame, states: DataFrame) -> DataFrame:
    """Links with the folded state of their url; a link without one keeps its own."""
    s = states.select("url", F.col("status").alias("_s"), F.col("error").alias("_e"), F.col("retries").alias("_r"))
    out = links.select("link_id", "url", "status", "error", "retry_count").join(s, "url", "left")
    return out.select("link_id", "url", F.coalesce("_s", "status").alias("status"), F.coalesce("_e", "error").alias("error"), (F.col("retry_count") + F.coalesce("_r", F.lit(0))).cast("long").alias("retry_count"))


def pending_of(links: DataFrame, states: DataFrame, retry_failed: bool = False, force: bool = False) -> DataFrame:
    """Distinct urls that still need a run: all if forced, unseen ones, and unsuccessful ones on demand."""
    urls = links.where("url is not null").select("url").distinct()
    if force:
        return urls
    done = states.where("status = 'scraped'" if retry_failed else "true").select("url")
    return urls.join(done, "url", "left_anti")


def results(links: DataFrame, states: DataFrame) -> DataFrame:
    """One row per link, ``not_processed`` where no state is known."""
    return links.select("link_id", "url").join(states.select("url", F.col("status").alias("_s")), "url", "left").select("link_id", F.coalesce("_s", F.lit("not_processed")).alias("status"))


def micro_batch(links: DataFrame, states: DataFrame, limit: int = 200) -> DataFrame:
    """The next urls to run: discovered, without a terminal state, oldest id first."""
    todo = links.where("url is not null").groupBy("url").agg(F.min("link_id").alias("link_id"))
    return todo.join(states.where("status <> 'pending'").select("url"), "url", "left_anti").orderBy("link_id").limit(limit)


def latest_value(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Key-value upsert: the last value of each key."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def run_history(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.col("id").desc()).limit(limit)


def interrupted(runs: DataFrame, message: str = "interrupted by restart") -> DataFrame:
    """Runs that a restart found running; their error is filled only where it is empty."""
    running = F.col("state") == "running"
    return runs.withColumn("error", F.when(running & (F.coalesce("error", F.lit("")) == ""), message).otherwise(F.col("error"))).withColumn("state", F.when(running, "interrupted").otherwise(F.col("state")))


def keep_newest(rows: DataFrame, group: str, order: str, keep: int) -> DataFrame:
    """Rotation: the rows beyond the ``keep`` newest of each group."""
    w = Window.partitionBy(group).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > keep).drop("_r")


def run_events(runs: DataFrame) -> DataFrame:
    """(id, event, at, name, command, state, exit_code, error): a run log as the events that made it, a start and, where it ended, a finish."""
    blank = {"name": "string", "command": "string", "state": "string", "exit_code": "int", "error": "string"}
    of = lambda **kw: [F.coalesce(kw.get(c, F.lit(None)).cast(t), F.lit(None).cast(t)).alias(c) for c, t in blank.items()]
    start = runs.select("id", F.lit("start").alias("event"), F.col("started_at").alias("at"), *of(name=F.col("name"), command=F.col("command")))
    ended = runs.where("state <> 'running'").select("id", F.lit("finish").alias("event"), F.col("finished_at").alias("at"), *of(state=F.col("state"), exit_code=F.col("exit_code"), error=F.col("error")))
    return start.unionByName(ended)


def runs_folded(events: DataFrame) -> DataFrame:
    """(id, name, command, state, started_at, finished_at, exit_code, error): one row per run.

    A run without a finish is running, without exit code; of several finishes the latest holds. An event with a NULL id is no run.
    """
    is_start = F.col("event") == "start"
    when = F.struct(F.col("at").isNotNull().alias("k"), F.col("at").alias("t"), F.coalesce("state", F.lit("")).alias("s"))
    begun = F.min_by(F.struct("name", "command", "at"), F.when(is_start, when)).alias("_b")
    ended = F.max_by(F.struct("state", "at", "exit_code", "error"), F.when(~is_start, when)).alias("_e")
    out = events.where("id is not null").groupBy("id").agg(begun, ended)
    return out.select("id", "_b.name", "_b.command", F.coalesce("_e.state", F.lit("running")).alias("state"), F.col("_b.at").alias("started_at"), F.coalesce("_e.at", F.lit("")).alias("finished_at"), "_e.exit_code", F.coalesce("_e.error", F.lit("")).alias("error"))
