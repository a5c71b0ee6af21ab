"""Source frames: rows of one device and stamp sliced into frames, fingerprinted and classified; nothing is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import cases, frame_fingerprint, identity
from gridloom.session import dealt, tasks_for

MAX_FRAMES, SEVERE_SHARE, STABLE_SHARE = 64, 0.5, 0.5
CANONICAL = ("UNIQUE", "SAME_TIMESTAMP_DISTINCT_FRAME")


def with_position(rows: DataFrame, connector: str = "connector_no", smr: str = "smr_no") -> DataFrame:
    """rows with position, as C1/S3; null (unassigned) where a part is missing."""
    c, s = identity(F.col(connector)), identity(F.col(smr))
    return rows.withColumn("position", F.when(c.isNotNull() & s.isNotNull(), F.concat(F.lit("C"), c, F.lit("/S"), s)))


def occurrence_index(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with occurrence: 0 for the first row of a key in source order, and so on."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def expected_topology(connectors: list[str], smrs: list[str]) -> list[str]:
    return sorted(f"C{c}/S{s}" for c in connectors for s in smrs)


def observed_topology(rows: DataFrame, share: float = STABLE_SHARE) -> DataFrame:
    """(charger_id, positions, support): positions in at least a share of the charger's stamps are stable."""
    groups = rows.where("position is not null").groupBy("charger_id", "position").agg(F.count_distinct("event_time").alias("support"))
    stamps = rows.groupBy("charger_id").agg(F.count_distinct("event_time").alias("stamps"))
    stable = groups.join(stamps, "charger_id").where(F.col("support") >= F.greatest(F.lit(1), F.floor(share * F.col("stamps"))))
    return stable.groupBy("charger_id").agg(F.array_sort(F.collect_list("position")).alias("expected"))


def slice_frames(rows: DataFrame, topology: DataFrame | None = None, order: str = "source_row_number") -> DataFrame:
    """Frames (file_id, charger_id, event_time, frame_sequence, positions, fingerprint, by_position, status).

    rows need file_id, charger_id, event_time, position, row_fp and a source order. Frame k holds the k-th occurrence
    of each position; a stamp with more than MAX_FRAMES becomes one AMBIGUOUS frame of first occurrences.
    `topology`: (charger_id, expected array<string>).
    """
    key = ["file_id", "charger_id", "event_time"]
    # one exchange by stamp serves all windows and aggregates up to the topology's join; a stamp's rows are few, in all its files
    rows = rows.where("position is not null and event_time is not null")
    tasks = tasks_for(rows.sparkSession, rows.count())
    rows = dealt(rows, tasks, "charger_id", "event_time")
    rows = occurrence_index(rows, [*key, "position"], [order])
    zero = F.first("row_fp").over(Window.partitionBy(*key, "position").orderBy(order))
    rows = rows.withColumn("_differs", F.col("row_fp") != zero)
    rows = rows.withColumn("_frames", F.max("occurrence").over(Window.partitionBy(*key)) + 1)
    rows = rows.where((F.col("_frames") <= MAX_FRAMES) | (F.col("occurrence") == 0))
    frames = rows.groupBy(*key, F.col("occurrence").alias("frame_sequence")).agg(
        F.array_sort(F.collect_list("position")).alias("positions"), frame_fingerprint(F.col("position"), F.col("row_fp")).alias("fingerprint"),
        F.map_from_entries(F.collect_list(F.struct("position", "row_fp"))).alias("by_position"), F.max("_frames").alias("frames"),
        F.bool_or("_differs").alias("differs_from_first"),
    )
    # where both sides are too large to be sent whole, frames go to as many tasks as the topology's rows
    frames = frames.join(dealt(topology, tasks, "charger_id") if tasks else topology, "charger_id", "left") if topology is not None else frames.withColumn("expected", F.lit(None).cast("array<string>"))
    inside = F.size(F.array_intersect("positions", "expected"))
    status = cases(
        [
            (F.col("frames") > MAX_FRAMES, "AMBIGUOUS"),
            (F.col("expected").isNull(), "AMBIGUOUS"),
            (F.size(F.array_except("positions", "expected")) > 0, "MALFORMED"),
            (inside >= F.size("expected"), "COMPLETE"),
            (inside < SEVERE_SHARE * F.size("expected"), "SEVERELY_INCOMPLETE"),
        ],
        "PARTIAL",
    )
    return frames.withColumn("status", status).withColumn("missing", F.array_except("expected", "positions"))


def classify_replays(frames: DataFrame) -> DataFrame:
    """frames with duplicate_class and replay_of: each against frame 0 of its stamp and earlier equal frames.

    A frame equal to an earlier one that was no partial replay is a full replay of the first such. Otherwise a shared
    position that differs from frame 0 makes it distinct, agreement on all shared ones a partial replay of frame 0,
    and no shared position ambiguous.
    """
    w = Window.partitionBy("file_id", "charger_id", "event_time").orderBy("frame_sequence")
    if "differs_from_first" in frames.columns:  # of slice_frames(): frame 0 has each position that a later frame has
        f = frames.withColumn("_zero", F.lit(None)).withColumn("_shared", F.size("positions")).withColumn("_differs", F.col("differs_from_first"))
    else:
        f = frames.withColumn("_zero", F.first("by_position").over(w))
        shared = F.array_intersect(F.map_keys("by_position"), F.map_keys("_zero"))
        f = f.withColumn("_shared", F.size(shared))
        f = f.withColumn("_differs", F.exists(shared, lambda p: F.col("by_position")[p] != F.col("_zero")[p]))
    partial = (F.col("frame_sequence") > 0) & (F.col("_shared") > 0) & ~F.col("_differs") & (F.col("fingerprint") != F.first("fingerprint").over(w))
    f = f.withColumn("_partial", partial)
    same = Window.partitionBy("file_id", "charger_id", "event_time", "fingerprint")
    f = f.withColumn("_first", F.min(F.when(~F.col("_partial"), F.col("frame_sequence"))).over(same))
    full = F.col("_first") < F.col("frame_sequence")
    kind = cases(
        [
            (F.col("frame_sequence") == 0, "UNIQUE"),
            (F.coalesce(full, F.lit(False)), "FULL_FRAME_REPLAY"),
            (F.col("_shared") == 0, "AMBIGUOUS"),
            (F.col("_differs"), "SAME_TIMESTAMP_DISTINCT_FRAME"),
        ],
        "PARTIAL_REPLAY",
    )
    f = f.withColumn("duplicate_class", kind)
    of = F.when(F.col("duplicate_class") == "FULL_FRAME_REPLAY", F.col("_first")).when(F.col("duplicate_class") == "PARTIAL_REPLAY", F.lit(0))
    return f.withColumn("replay_of", of.cast("long")).drop("_zero", "_shared", "_differs", "_partial", "_first")


def canonical(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("duplicate_class").isin(list(CANONICAL)))


def reuse_across_files(frames: DataFrame, any_time: bool = False) -> DataFrame:
    """frames with is_source_of: the first received frame of a charger, stamp and fingerprint; later ones are sources of it.

    any_time also joins equal payloads of different stamps.
    """
    keys = ["charger_id", "fingerprint"] + ([] if any_time else ["event_time"])
    w = Window.partitionBy(*keys).orderBy("received_at", "event_time", "frame_sequence", "file_id")
    return frames.withColumn("_n", F.row_number().over(w)).withColumn("first_file", F.first("file_id").over(w)).withColumn("is_source", F.col("_n") > 1).drop("_n")


def next_sequence(frames: DataFrame) -> DataFrame:
    """frames renumbered over all files of a charger and stamp, in the order received."""
    w = Window.partitionBy("charger_id", "event_time").orderBy("received_at", "file_id", "frame_sequence")
    return frames.withColumn("frame_sequence", F.row_number().over(w) - 1)


STORED = "charger_id string, event_time timestamp, fingerprint string, file_id string, stored_sequence long"


def against_stored(frames: DataFrame, stored: DataFrame, rows: int | None = None) -> DataFrame:
    """Frames of a batch of files with what storing them gives: is_source, first_file and stored_sequence.

    A frame of a charger, stamp and fingerprint that an earlier file has, stored or of the batch, is one more source of
    that file's frame (first_file) and takes no number (null). Others, repetitions within their own file too, are numbered
    on from the stored ones of their charger and stamp, in the order received. Batches in the order received give what one run over
    all their files gives. `stored` has the columns of STORED, for the batch's stamps at least.
    `rows`: how many of both there are at most; counted if not given.
    """
    stamp, same = ["charger_id", "event_time"], ["charger_id", "event_time", "fingerprint"]
    order = ["received_at", "file_id", "frame_sequence"]
    past = stored.select(*same, F.struct("stored_sequence", "file_id").alias("_old"))
    both = frames.withColumn("_new", F.struct(*order)).unionByName(past, allowMissingColumns=True)
    # frames and stored ones meet in one exchange by stamp, so nothing is joined
    both = dealt(both, tasks_for(frames.sparkSession, both.count() if rows is None else rows), *stamp)
    known, first = F.min("_old").over(Window.partitionBy(*same)), F.min("_new").over(Window.partitionBy(*same))
    found = both.withColumn("_known", known["file_id"]).withColumn("first_file", F.coalesce("_known", first["file_id"]))
    found = found.withColumn("_next", F.max("_old").over(Window.partitionBy(*stamp))["stored_sequence"] + 1).where("_new is not null")
    found = found.withColumn("is_source", F.col("_known").isNotNull() | (F.col("file_id") != F.col("first_file")))
    number = F.row_number().over(Window.partitionBy(*stamp, "is_source").orderBy(*order)) - 1 + F.coalesce("_next", F.lit(0))
    return found.withColumn("stored_sequence", F.when(~F.col("is_source"), number).cast("long")).drop("_old", "_new", "_known", "_next")


def summary(frames: DataFrame, *by: str) -> DataFrame:
    """Counts of statuses and classes, stamps and canonical collisions."""
    stamps = frames.groupBy(*by, "charger_id", "event_time").agg(F.count_if(F.col("duplicate_class").isin(list(CANONICAL))).alias("_c"), F.count("*").alias("_n"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("COMPLETE", "PARTIAL", "SEVERELY_INCOMPLETE", "MALFORMED", "AMBIGUOUS")), F.count_if(F.col("duplicate_class") == "FULL_FRAME_REPLAY").alias("full_replays"))
    sums = ("complete", "partial", "severely_incomplete", "malformed", "ambiguous", "full_replays")
    return stamps.groupBy(*by).agg(F.count("*").alias("timestamps"), F.sum("_n").alias("frames"), F.count_if(F.col("_c") > 1).alias("collision_timestamps"), *(F.sum(s).alias(s) for s in sums))


def collisions(frames: DataFrame) -> DataFrame:
    """Stamps with more than one canonical frame."""
    return canonical(frames).groupBy("charger_id", "event_time").agg(F.count("*").alias("frames")).where("frames > 1")


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two frames' rows (position, row_fp) by position: same, differs, only_left, only_right."""
    both = left.select("position", F.col("row_fp").alias("left_fp")).join(right.select("position", F.col("row_fp").alias("right_fp")), "position", "full_outer")
    kind = cases([(F.col("right_fp").isNull(), "only_left"), (F.col("left_fp").isNull(), "only_right"), (F.col("left_fp") == F.col("right_fp"), "same")], "differs")
    return both.withColumn("outcome", kind)


def first_seen_duplicates(rows: DataFrame, by: Column | str, fp: str) -> DataFrame:
    """(by, repeated_rows): rows whose fingerprint an earlier row of the group has."""
    counts = rows.groupBy(by, fp).agg(F.count("*").alias("_n"))
    return counts.groupBy(by).agg(F.sum(F.col("_n") - 1).alias("repeated_rows"))


def resolve_topology(chargers: DataFrame, rows: DataFrame, default: tuple[int, int] | None = None) -> DataFrame:
    """(charger_id, expected, source): positions from a charger's own counts, else the default's, else those that are stable
    in its rows, else none (UNRESOLVED). chargers: charger_id, expected_connector_count, expected_smr_count."""
    grid = lambda c, s: F.array_sort(F.flatten(F.transform(F.sequence(F.lit(1), c), lambda i: F.transform(F.sequence(F.lit(1), s), lambda j: F.concat(F.lit("C"), i.cast("string"), F.lit("/S"), j.cast("string"))))))
    c, s = F.col("expected_connector_count"), F.col("expected_smr_count")
    own = F.when((c > 0) & (s > 0), grid(F.greatest(c, F.lit(1)), F.greatest(s, F.lit(1))))
    usual = grid(F.lit(default[0]), F.lit(default[1])) if default else F.lit(None).cast("array<string>")
    seen = observed_topology(rows).withColumnRenamed("expected", "_seen")
    both = chargers.withColumn("_own", own).withColumn("_usual", usual).join(seen, "charger_id", "left")
    source = cases([(F.col("_own").isNotNull(), "CHARGER"), (F.col("_usual").isNotNull(), "DEFAULT"), (F.col("_seen").isNotNull(), "OBSERVED")], "UNRESOLVED")
    return both.select("charger_id", F.coalesce("_own", "_usual", "_seen").alias("expected"), source.alias("source"))
