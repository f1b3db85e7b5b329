"""Asking a verdict again: which segments of an archive are walked anew, and what stands until then.

A wrong start may have been handed to the segment where a chain ended, so the chain is walked again from the one before; and if that comes
to the same verdict, from one further back each time.  Notes (archive_id, idx, state, exit_offset, again) remember each archive's last question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .archives import chain_ending

NOTES = "archive_id long, idx int, state string, exit_offset long, again int"


def questions(segments: DataFrame, archives: DataFrame, notes: DataFrame) -> DataFrame:
    """(archive_id, idx, state, exit_offset, again, further): where each archive's chain ended, and the segment to walk again from.

    again: the segment before the ending one, or before the one asked last if the verdict (segment, state and offset) is the same as
    then; 0 at least.  Stale archives are left out (only a registration lifts that).  These rows, without ``further``, are the new notes.
    """
    live = archives.filter("state <> 'stale'").select(F.col("id").alias("archive_id"))
    ending = chain_ending(segments.join(live, "archive_id", "left_semi")).select("archive_id", "idx")
    told = segments.join(ending, ["archive_id", "idx"]).select("archive_id", "idx", "state", "exit_offset")
    last = notes.select("archive_id", F.struct("idx", "state", "exit_offset").alias("verdict"), F.col("again").alias("_again"))
    both = told.join(last, "archive_id", "left")
    same = F.coalesce(F.struct("idx", "state", "exit_offset").eqNullSafe(F.col("verdict")), F.lit(False))
    begin = F.greatest(F.when(same, F.col("_again")).otherwise(F.col("idx")) - 1, F.lit(0))
    return both.select("archive_id", "idx", "state", "exit_offset", begin.cast("int").alias("again"), same.alias("further"))


def restated(segments: DataFrame, asked: DataFrame) -> DataFrame:
    """Segments once their archives are asked again: from ``again`` on pending; those up to the ending keep their starts, but joined only the first; those after it lie beyond."""
    at = asked.select("archive_id", F.col("idx").alias("_end"), "again")
    rows = segments.join(at, "archive_id", "left")
    old = F.col("again").isNull() | (F.col("idx") < F.col("again"))
    after = F.col("idx") > F.col("_end")
    nothing = {c: F.when(old, F.col(c)) for c in ("exit_offset", "cursor_offset", "detail") if c in segments.columns}
    changed = {
        "state": F.when(old, F.col("state")).when(after, "beyond").otherwise("pending"),
        "joined": F.when(old, F.col("joined")).otherwise(F.col("idx") == F.col("again")),
        "first_header": F.when(old | ~after, F.col("first_header")),
        "members": F.when(old, F.col("members")).otherwise(0),
    }
    return rows.withColumns({c: v for c, v in (changed | nothing).items() if c in segments.columns}).select(*segments.columns)


def standing(members: DataFrame, asked: DataFrame) -> DataFrame:
    """Members without those of the segments that are walked again."""
    at = asked.select("archive_id", "again")
    return members.join(at, "archive_id", "left").filter("again is null or segment < again").select(*members.columns)


def rearmed(segments: DataFrame, crossed: DataFrame) -> DataFrame:
    """Segments once chains have crossed into retired ones: ``crossed`` (archive_id, idx) and all retired after it are to be walked again."""
    rows = segments.join(crossed.select("archive_id", F.col("idx").alias("_from")), "archive_id", "left")
    back = F.coalesce((F.col("idx") >= F.col("_from")) & (F.col("state") == "beyond"), F.lit(False))
    return rows.withColumns({"state": F.when(back, "pending").otherwise(F.col("state")), "first_header": F.when(~back, F.col("first_header")), "joined": ~back & F.col("joined")}).select(*segments.columns)
