"""Upserts, dated revisions and ingestion runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from provenant.functions.hashing import content_hash, stable_id
from provenant.functions.language import translation_status

ACT_FIELDS = ["short_name", "full_name_en", "full_name_bn", "act_number", "act_year", "ministry", "status"]


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], updates: Sequence[str],
           position: str | None = None) -> DataFrame:
    """Merge by key: matched rows take ``updates`` from incoming, others are kept or added.

    Adds ``outcome``: inserted, updated, unchanged or untouched. A key repeated in ``incoming``
    keeps its last row by ``position``.
    """
    columns = current.columns
    if position is not None:
        names = [c for c in incoming.columns if c not in keys]
        last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*names), position).alias("_r"))
        incoming = last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in names])
    old = current.select(*keys, F.struct(*columns).alias("_old"))
    new = incoming.select(*keys, F.struct(*[c for c in columns if c in incoming.columns]).alias("_new"))
    both = old.join(new, list(keys), "full_outer")
    given = set(incoming.columns)

    def value(c: str) -> Column:
        if c not in given:
            return F.col(f"_old.{c}")
        if c in updates:
            return F.when(F.col("_new").isNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}"))
        return F.when(F.col("_old").isNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))

    same = reduce(lambda a, b: a & b,
                  [F.equal_null(F.col(f"_old.{c}"), F.col(f"_new.{c}")) for c in updates], F.lit(True))
    outcome = (F.when(F.col("_new").isNull(), "untouched").when(F.col("_old").isNull(), "inserted")
               .when(same, "unchanged").otherwise("updated"))
    return both.select(*[(F.col(c) if c in keys else value(c)).alias(c) for c in columns],
                       outcome.alias("outcome"))


def upsert_registry(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(current, incoming, ["slug"], ACT_FIELDS)


def upsert_provisions(current: DataFrame, incoming: DataFrame, position: str = "ordinal") -> DataFrame:
    """Known paths take a new title and number; kind and parent stay as first stored."""
    stored = incoming.withColumn("kind", F.when(F.col("kind") == "act", "section").otherwise(F.col("kind")))
    return upsert(current, stored, ["act_id", "sort_path"], ["title", "number"], position)


_KEYS = ["provision_id", "language"]


def hashed(incoming: DataFrame) -> DataFrame:
    """The rows with text, and the hash of it."""
    return incoming.filter(F.coalesce("text", F.lit("")) != "").withColumn("content_hash", content_hash(F.col("text")))


def judge(heads: DataFrame, incoming: DataFrame) -> DataFrame:
    """The batch with an outcome per key and fetch, beside the open row of its key.

    ``heads``: provision_id, language, _hash, _since of the open rows and whatever else names them; no text is needed.
    ``incoming`` has texts, or the content_hash of them.
    """
    optional = {"effective_from": "date", "amended_from": "date", "provenance": "string", "ordinal": "int"}
    for name, kind in optional.items():
        if name not in incoming.columns:
            incoming = incoming.withColumn(name, F.lit(None).cast(kind))
    written = hashed(incoming) if "text" in incoming.columns else incoming
    fields = [c for c in ("text", "source_url", *optional, "content_hash") if c in written.columns]
    position = F.struct(F.coalesce("ordinal", F.lit(0)), "content_hash")
    batch = written.groupBy(*_KEYS, "fetched_at").agg(F.max_by(F.struct(*fields), position).alias("_r"),
                                                      (F.count(F.lit(1)) - 1).alias("collisions"))
    batch = batch.select(*_KEYS, "fetched_at", "collisions", *[F.col(f"_r.{f}").alias(f) for f in fields])

    day = F.to_date("fetched_at")
    in_time = Window.partitionBy(*_KEYS, "_stale").orderBy("fetched_at")
    before = F.coalesce(F.lag("content_hash").over(in_time), F.col("_hash"))
    return (batch.join(heads, _KEYS, "left")
            .withColumn("_stale", F.coalesce((day < F.col("_since")) & (F.col("_hash") != F.col("content_hash")), F.lit(False)))
            .withColumn("_before", before)
            .withColumn("outcome", F.when(F.col("_stale"), "stale").when(F.col("_before").isNull(), "new")
                        .when(F.col("_before") == F.col("content_hash"), "unchanged").otherwise("updated")))


def inserted(judged: DataFrame) -> DataFrame:
    """The revisions that a judged batch opens; all but the last of a key are closed by the next."""
    day = F.to_date("fetched_at")
    return judged.filter(F.col("outcome").isin("new", "updated")).withColumn(
        "_until", F.lead(day).over(Window.partitionBy(*_KEYS).orderBy("fetched_at"))).select(
        stable_id(*[F.col(k) for k in _KEYS], day, F.col("content_hash")).alias("id"), *_KEYS,
        translation_status(F.col("language")).alias("translation_status"), *[c for c in ("text",) if c in judged.columns],
        F.coalesce("effective_from", "amended_from", day).alias("effective_from"),
        F.col("_until").alias("effective_to"), F.lit(None).cast("string").alias("amending_act_id"),
        F.coalesce("provenance", F.lit("snapshot")).alias("provenance"), "content_hash", "source_url",
        "fetched_at")


def closing(judged: DataFrame, *names: str) -> DataFrame:
    """The open rows, by key and ``names``, that a judged batch closes, with the day."""
    return judged.filter(F.col("outcome").isin("new", "updated") & F.col("_hash").isNotNull()).groupBy(
        *_KEYS, *names).agg(F.min(F.to_date("fetched_at")).alias("_closed"))


def outcomes_of(judged: DataFrame) -> DataFrame:
    return judged.select(*_KEYS, "outcome", "collisions", "content_hash", F.to_date("fetched_at").alias("fetched_on"))


def merge_revisions(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(revisions after the merge, outcomes), per (provision_id, language).

    ``incoming``: provision_id, language, text, source_url, fetched_at, and optionally
    effective_from, amended_from, provenance and ordinal. Equal text leaves the open row; other
    text closes it on the day of the fetch and opens a new one. Several fetches of a key in one batch
    are taken in time order, so each change of its text becomes a revision. Texts are compared by hash,
    and of the stored rows only the open ones are joined, without their text being needed for it.
    ``bucketed.merge_revisions`` does the same to a stored table by appending to it.

    Outcomes have a row per key and fetch. ``collisions`` counts further rows of the same fetch,
    of which the last on the page wins. A fetch older than the open row is ignored as stale.
    """
    judged = judge(current.filter("effective_to is null").select(
        *_KEYS, F.col("content_hash").alias("_hash"), F.col("effective_from").alias("_since")), incoming)
    closed, still = current.filter("effective_to is not null"), current.filter("effective_to is null")
    still = still.join(closing(judged), _KEYS, "left").withColumn("effective_to", F.col("_closed")).select(*current.columns)
    return (closed.unionByName(still).unionByName(inserted(judged), allowMissingColumns=True).select(*current.columns),
            outcomes_of(judged))


def pending_revisions(revisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Open revisions this run wrote: the only ones to chunk and embed."""
    fresh = outcomes.filter(F.col("outcome").isin("new", "updated")).select("provision_id", "language")
    return revisions.filter("effective_to is null").join(fresh, ["provision_id", "language"], "left_semi")


def replace_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks of rewritten revisions give way to the fresh ones; others stay."""
    kept = chunks.join(fresh.select("revision_id").distinct(), "revision_id", "left_anti")
    return kept.select(*chunks.columns).unionByName(fresh.select(*chunks.columns))


def ingest_summary(outcomes: DataFrame, by: Sequence[str] = (), chunks: DataFrame | None = None) -> DataFrame:
    """Counts of new, updated and unchanged revisions, and of chunks when given."""
    events = outcomes.select(*by, "outcome")
    if chunks is not None:
        events = events.unionByName(chunks.select(*by, F.lit("chunk").alias("outcome")))
    names = {"new": "n_new", "updated": "n_updated", "unchanged": "n_unchanged"}
    if chunks is not None:
        names["chunk"] = "n_chunks"
    return events.groupBy(*by).agg(
        *[F.count_if(F.col("outcome") == o).alias(n) for o, n in names.items()])


def split_not_modified(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages to parse, run rows of pages the source reports as unchanged)."""
    flag = F.coalesce("not_modified", F.lit(False))
    return pages.filter(~flag), pages.filter(flag).select(
        F.col("slug").alias("act_id"), "language", F.lit("unchanged").alias("outcome"),
        F.lit(None).cast("string").alias("error"), F.lit(0).alias("chunks"))


def run_log(steps: DataFrame, started_at: Column, finished_at: Column) -> DataFrame:
    """One run row per (act_id, language) from rows of (outcome, error, chunks).

    A row with an error fails its own run only. A null outcome counts as no provision.
    """
    runs = steps.groupBy("act_id", "language").agg(
        F.max("error").alias("error"),
        F.count_if(F.col("outcome").isin("new", "updated", "unchanged")).cast("int").alias("_seen"),
        F.sum(F.coalesce("chunks", F.lit(0))).cast("int").alias("_chunks"))
    failed = F.col("error").isNotNull()
    return runs.select(
        stable_id(F.col("act_id"), F.col("language"), started_at).alias("id"), "act_id", "language",
        F.when(failed, "failed").otherwise("succeeded").alias("status"),
        started_at.alias("started_at"), finished_at.alias("finished_at"),
        F.when(failed, 0).otherwise(F.col("_seen")).alias("provisions_processed"),
        F.when(failed, 0).otherwise(F.col("_chunks")).alias("chunks_created"), "error")


def cancel_runs(runs: DataFrame, now: Column, act: str | None = None) -> DataFrame:
    """Running rows become failed, for all acts or one."""
    hit = F.col("status") == "running"
    if act is not None:
        hit = hit & (F.col("act_id") == act)
    return runs.withColumns({
        "status": F.when(hit, "failed").otherwise(F.col("status")),
        "error": F.when(hit, "Cancelled by operator").otherwise(F.col("error")),
        "finished_at": F.when(hit, now).otherwise(F.col("finished_at"))})


def open_windows(events: DataFrame, key: str, at: str, order: Sequence[str]) -> DataFrame:
    """State history to dated rows: each row holds from its day until the next one starts.

    The next row is sought within the day first; the last row of a day takes the first moment
    of the key's next day, so a busy key is spread over its days.
    """
    days = events.groupBy(key, F.to_date(at).alias("_day")).agg(F.min(at).alias("_first"))
    following = days.select(key, "_day", F.lead("_first").over(Window.partitionBy(key).orderBy("_day")).alias("_later"))
    inside = Window.partitionBy(key, "_day").orderBy(at, *order)
    rows = events.withColumn("_day", F.to_date(at)).withColumn("_next", F.lead(at).over(inside)).join(following, [key, "_day"])
    return rows.withColumns({"effective_from": F.col("_day"),
                             "effective_to": F.to_date(F.coalesce("_next", "_later"))}).drop("_day", "_next", "_later")
