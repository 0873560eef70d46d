"""Which papers are pending, done or failed, and which copy of a paper counts."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import urls
from scholium.plans import skew

# Sources in the order they are tried, and the kinds of artifact that stop each one.
SOURCE_ORDER = {
    "archive": ("pdf", "html"),
    "mirror": ("pdf", "html"),
    "publisher_link": ("pdf", "html"),
    "publisher_text": ("pdf", "html", "txt"),
    "publisher_api": ("pdf", "html", "txt"),
}
ABSTRACT_KINDS = ("txt",)
ABSTRACTS_PER_BATCH = 1000


def pending_ids(ids: DataFrame, artifacts: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Ids without an artifact of one of ``kinds``.

    Artifacts shrink to distinct ids before the shuffle, however many one id has. Id lists may
    hold one id any number of times.
    """
    done = artifacts.filter(F.col("kind").isin(*kinds)).select("pmid").distinct()
    return skew.membership(ids, done, "pmid", "left_anti")


def route_identifiers(df: DataFrame, col: str = "identifier") -> DataFrame:
    """Add ``id_class``: url-direct, url-non-direct, pmid or doi."""
    return df.withColumn("id_class", urls.identifier_class(F.col(col)))


def count_by(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(out))


def page_outcome_counts(outcomes: DataFrame) -> DataFrame:
    """``(status, n)``."""
    return count_by(outcomes, "status")


def _best(columns: Sequence[Column]) -> Column:
    return F.array_min(F.array(*columns))


def first_source_wins(
    candidates: DataFrame,
    artifacts: DataFrame,
    sources: Mapping[str, Sequence[str]] = SOURCE_ORDER,
    carry: Sequence[str] = ("kind",),
) -> DataFrame:
    """``(pmid, source, carry)``: of ``candidates(pmid, source, ...)``, the first source that may fill a gap.

    A source is out for an id that already has an artifact of one of the kinds that stop it. Both
    sides shrink to one row per id before they meet, so repeated candidates of one id combine on
    the map side.
    """
    names = list(sources)
    priority = F.array_position(F.lit(names), F.col("source"))
    row = F.struct(priority.alias("priority"), "source", *carry)
    stops = list(dict.fromkeys(tuple(sorted(kinds)) for kinds in sources.values()))
    members = [[s for s in names if tuple(sorted(sources[s])) == kinds] for kinds in stops]

    best = candidates.filter(F.col("source").isin(*names)).groupBy("pmid").agg(
        *[F.min(F.when(F.col("source").isin(*group), row)).alias(f"best{i}") for i, group in enumerate(members)]
    )
    held = artifacts.groupBy("pmid").agg(
        *[F.bool_or(F.col("kind").isin(*kinds)).alias(f"stop{i}") for i, kinds in enumerate(stops)]
    )
    open_ = [
        F.when(~F.coalesce(F.col(f"stop{i}"), F.lit(False)), F.col(f"best{i}")) for i in range(len(stops))
    ]
    winners = best.join(held, "pmid", "left").select("pmid", _best(open_).alias("w"))
    return winners.filter(F.col("w").isNotNull()).select("pmid", "w.source", *[f"w.{c}" for c in carry])


def backfill_abstracts(
    ids: DataFrame, abstracts: DataFrame, artifacts: DataFrame, batch: int = ABSTRACTS_PER_BATCH
) -> DataFrame:
    """``(pmid, batch_no, abstract)`` for ids that have no text yet.

    Pending ids are numbered by ``ord`` and cut into batches. Abstracts are matched by id, and
    null or empty ones are dropped.
    """
    pending = skew.number_rows(pending_ids(ids, artifacts, ABSTRACT_KINDS), "ord")
    numbered = pending.select("pmid", F.expr(f"(row_no - 1) div {batch}").alias("batch_no"))
    found = abstracts.filter(F.length("abstract") > 0).groupBy("pmid").agg(F.min("abstract").alias("abstract"))
    return numbered.join(found, "pmid")


def acquisition_report(ids: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``(pmid, status)``, ``done`` or ``failed``, one row per id."""
    done = done_ids(ids, artifacts).withColumn("status", F.lit("done"))
    return done.unionByName(failed_ids(ids, artifacts).withColumn("status", F.lit("failed")))


def failed_ids(ids: DataFrame, artifacts: DataFrame) -> DataFrame:
    return skew.membership(ids, artifacts.select("pmid").distinct(), "pmid", "left_anti").select("pmid")


def done_ids(ids: DataFrame, artifacts: DataFrame) -> DataFrame:
    return skew.membership(ids, artifacts.select("pmid").distinct(), "pmid", "left_semi").select("pmid")


def content_key(df: DataFrame, content: str = "content", url: str = "url") -> DataFrame:
    """Add ``content_key``, the name under which a download is stored."""
    return df.withColumn("content_key", urls.content_key(F.col(content), F.col(url)))


def content_key_collisions(df: DataFrame) -> DataFrame:
    """``(content_key, n)`` for keys that more than one row has."""
    return count_by(df, "content_key").filter(F.col("n") > 1)
