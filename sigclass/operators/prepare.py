"""Session selection, session ⋈ packets, label index and channel categories.

Covers F1/F2 (eligibility), J1/J3 (sessions ⋈ / ⋉ packets), A1 (packets per
session), A2 (label index: frequency-descending, ties alphabetical), A3
(channel categories: <= MAX_CATEGORIES distinct values, ascending with 0.0
first), P7/P8 (applying both). All of it is set-wise over every session at
once; no per-session loop and no collect.

Grouping never puts a session's packets into one task: every aggregation
over packets is a hash aggregate with a map-side partial step, and the only
window functions run over per-session summaries bounded by the label domain
or by MAX_CATEGORIES. Label counts and a bitmap of hashed values per channel come from
one pass (``session_profile``); only channels the bitmap cannot rule out as
continuous are deduplicated exactly — either on their own
(``channel_index_fit``) or inside the training pass (``fit_pass``), which
also yields the per-class sufficient statistics for naive Bayes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigclass.functions.labels import encode
from sigclass.functions.packets import NOT_FINITE, packet_reason, stored_vector, vector_ok
from sigclass.functions.split import is_train
from sigclass.operators.joins import DEFAULT_MAX_BROADCAST_ROWS, join_small
from sigclass.schemas import LABELS, MAX_CATEGORIES, N_CHANNELS, TRAIN_PERCENT

#: Bits of a channel's bitmap of hashed values: those of a long.
BITMAP = 64


# --------------------------------------------------------------------- filters

def eligible_calibrations(calibrations: DataFrame) -> DataFrame:
    """finished sessions whose models are not generated yet (NULL flag = not yet)."""
    return calibrations.where(
        F.col("enddate").isNotNull() & ~F.coalesce(F.col("modelsgenerated"), F.lit(False)))


def ready_calibrations(calibrations: DataFrame) -> DataFrame:
    """Sessions whose models exist (pushed boolean filter)."""
    return calibrations.where(F.col("modelsgenerated"))


def session_packets(packets: DataFrame, calibrationid: str) -> DataFrame:
    """Packets of one session (pushed key equality)."""
    return packets.where(F.col("calibrationid") == F.lit(calibrationid))


def trainable_calibrations(calibrations: DataFrame, packets: DataFrame) -> DataFrame:
    """Eligible sessions that have at least one packet (left semi join)."""
    return eligible_calibrations(calibrations).join(
        packets.select("calibrationid"), "calibrationid", "left_semi")


def packets_per_calibration(packets: DataFrame) -> DataFrame:
    """A1: packet count per session."""
    return packets.groupBy("calibrationid").agg(F.count(F.lit(1)).alias("n_packets"))


# ------------------------------------------------------------------------ join

def training_frame(calibrations: DataFrame, packets: DataFrame,
                   max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                   broadcast: bool | None = None) -> DataFrame:
    """J1 + P3: packets of eligible sessions with their channel vector.

    Output: pk, calibrationid, userid, label, features (array<double>), reason
    (why the packet cannot be used; NULL if it can) and valid. The session side has
    one narrow row per session and is broadcast when proven small.
    """
    sessions = calibrations if calibrations.columns == ["calibrationid"] else \
        eligible_calibrations(calibrations).select("calibrationid")
    return packet_frame(join_small(packets, sessions, "calibrationid", "inner", max_broadcast_rows, broadcast))


def packet_frame(packets: DataFrame) -> DataFrame:
    """Stored packets with their vector, reason and valid: the stored vector where there is one, else
    the parsed strings (rows stored without it). A table without strings has only its vectors."""
    rows = packets.select("pk", "calibrationid", "userid", "label", stored_vector(packets).alias("features"))
    # valid is what a NULL reason says, in an expression of its own: a filter by the reason outgrows a compiled method
    known = F.coalesce(F.col("label").isin(*LABELS), F.lit(False))
    return rows.withColumn("reason", packet_reason()).withColumn("valid", vector_ok("features") & known)


def invalid_packets(frame: DataFrame) -> DataFrame:
    """Packets of each session that cannot be used: calibrationid, reason, n."""
    return frame.where(~F.col("valid")).groupBy("calibrationid", "reason").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ session profile

def value_bit(x: Column) -> Column:
    """The bit that a channel's value sets in its session's bitmap (NULL sets none)."""
    place = F.pmod(F.xxhash64(x + F.lit(0.0)), F.lit(BITMAP)).cast("int")
    return F.when(x.isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), place))


def session_profile(frame: DataFrame, n_channels: int = N_CHANNELS,
                    features: str = "features") -> DataFrame:
    """One pass over the packets: per session, label counts and a lower bound of each channel's number of values.

    Output: calibrationid, label_counts array<struct<label, n>> (labels with
    n > 0), approx_distinct array<long> (one per channel), n_invalid and
    n_not_finite (packets left out, and those of them with a value that is not
    finite). Only valid packets enter the first two. Each value of a channel sets one of
    ``BITMAP`` bits, by its hash; the bits set are never more than the values, so more than
    MAX_CATEGORIES of them prove a channel continuous. Bitmaps are
    longs, so this stays a compiled hash aggregate with 8 bytes a channel. -0.0 is
    folded into 0.0 first (x + 0.0) so both count as one value, as in grouping.
    """
    f = F.col(features)
    valid = F.col("valid") if "valid" in frame.columns else F.lit(True)
    reason = F.col("reason") if "reason" in frame.columns else F.lit(None).cast("string")
    aggs = [F.count_if(valid & (F.col("label") == F.lit(lab))).alias(f"_l{i}") for i, lab in enumerate(LABELS)]
    aggs += [F.bit_or(F.when(valid, value_bit(F.get(f, F.lit(j))))).alias(f"_d{j}") for j in range(n_channels)]
    aggs += [F.count_if(~valid).alias("n_invalid"), F.count_if(reason == NOT_FINITE).alias("n_not_finite")]
    g = frame.groupBy("calibrationid").agg(*aggs)
    counts = F.filter(F.array(*[F.struct(F.lit(lab).alias("label"), F.col(f"_l{i}").alias("n"))
                                for i, lab in enumerate(LABELS)]), lambda e: e["n"] > 0)
    return g.select("calibrationid", counts.alias("label_counts"),
                    F.array(*[F.coalesce(F.bit_count(f"_d{j}"), F.lit(0)).cast("long") for j in range(n_channels)]).alias(
                        "approx_distinct"), "n_invalid", "n_not_finite")


# ---------------------------------------------------------------- label index

def label_index_fit(frame: DataFrame | None, profile: DataFrame | None = None) -> DataFrame:
    """A2/O1: (calibrationid, label, n, label_idx) — index by count desc, then label asc.

    Counts come from the session profile (one pass, conditional counts over
    the closed label domain); the window then ranks at most len(LABELS) rows
    per session.
    """
    p = profile if profile is not None else session_profile(frame)
    counts = p.select("calibrationid", F.inline("label_counts"))
    w = Window.partitionBy("calibrationid").orderBy(F.desc("n"), F.asc("label"))
    return counts.withColumn("label_idx", (F.row_number().over(w) - 1).cast("double"))


def label_orders(label_index: DataFrame) -> DataFrame:
    """(calibrationid, labels): the fitted label order as an array (index = position)."""
    s = label_index.groupBy("calibrationid").agg(
        F.array_sort(F.collect_list(F.struct("label_idx", "label"))).alias("_l"))
    return s.select("calibrationid", F.transform("_l", lambda e: e["label"]).alias("labels"))


# -------------------------------------------------------------- channel index

def channel_candidates(profile: DataFrame, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """(calibrationid, cand array<int>): channels whose bitmap does not rule out categorical."""
    idx = F.sequence(F.lit(0), F.size("approx_distinct") - 1)
    return profile.select("calibrationid", F.filter(
        idx, lambda j: F.element_at("approx_distinct", j + 1) <= max_categories).alias("cand"))


def channel_distinct_values(frame: DataFrame, candidates: DataFrame | None = None,
                            features: str = "features", broadcast: bool | None = None) -> DataFrame:
    """(calibrationid, channel, value) deduplicated (map-side partial aggregation).

    With ``candidates`` only the candidate channels of each session are
    emitted, so continuous channels are never shuffled value by value.
    """
    if candidates is None:
        stacked = frame.select("calibrationid", F.posexplode(features).alias("channel", "value"))
    else:
        j = join_small(frame, candidates.where(F.size("cand") > 0), "calibrationid", "inner",
                       broadcast=broadcast)
        stacked = j.select("calibrationid", F.inline(F.transform(
            "cand", lambda c: F.struct(c.alias("channel"),
                                       F.element_at(features, c + 1).alias("value")))))
    return stacked.withColumn("value", F.col("value") + F.lit(0.0)).distinct()


def channel_index_fit(frame: DataFrame, max_categories: int = MAX_CATEGORIES,
                      features: str = "features", profile: DataFrame | None = None,
                      broadcast: bool | None = None) -> DataFrame:
    """A3: (calibrationid, channel, value, code) for every categorical channel.

    A channel is categorical in a session when it takes at most
    ``max_categories`` distinct values there. Codes are 0..k-1 in ascending
    value order, except that 0.0, when present, always gets code 0. Channels
    proven continuous by the profile's bitmap are skipped; the rest
    are counted exactly, and only channels with at most ``max_categories``
    values are ranked, so no window partition holds more rows than that.
    """
    p = profile if profile is not None else session_profile(frame)
    distinct = channel_distinct_values(frame, channel_candidates(p, max_categories), features,
                                       broadcast)
    n = distinct.groupBy("calibrationid", "channel").agg(F.count(F.lit(1)).alias("n_values"))
    cat = n.where(F.col("n_values") <= max_categories).select("calibrationid", "channel")
    vals = distinct.join(cat, ["calibrationid", "channel"], "left_semi")
    w = Window.partitionBy("calibrationid", "channel").orderBy(
        (F.col("value") != 0.0).asc(), F.col("value").asc())
    return vals.withColumn("code", (F.dense_rank().over(w) - 1).cast("double"))


def category_maps(channel_index: DataFrame) -> DataFrame:
    """(calibrationid, cat_maps map<int, map<double,double>>): value -> code per categorical channel."""
    per_channel = channel_index.groupBy("calibrationid", "channel").agg(
        F.map_from_entries(F.collect_list(F.struct("value", "code"))).alias("m"))
    return per_channel.groupBy("calibrationid").agg(
        F.map_from_entries(F.collect_list(F.struct("channel", "m"))).alias("cat_maps"))


def apply_categories(features: Column | str = "features", cat_maps: Column | str = "cat_maps",
                     n_channels: int = N_CHANNELS) -> Column:
    """Re-code categorical channels; an unseen category gets code k (handleInvalid=keep).

    Unrolled over the channels, so that it is compiled; lambdas would be interpreted."""
    f = F.col(features) if isinstance(features, str) else features
    m = F.col(cat_maps) if isinstance(cat_maps, str) else cat_maps

    def one(j):
        x, cm = F.get(f, F.lit(j)), F.try_element_at(m, F.lit(j))
        return F.when(cm.isNull(), x).otherwise(
            F.coalesce(F.try_element_at(cm, x), F.size(cm).cast("double")))
    return F.when(f.isNotNull(), F.array(*[one(j) for j in range(n_channels)]))


def category_columns(cat_maps: Column | str = "cat_maps", n_channels: int = N_CHANNELS) -> list[Column]:
    """The category maps of a session as columns for each channel, _map{j} and its size _size{j} (NULL: not categorical).

    Taken on the side that has one row per session, they spare its packets the look-up of maps in a map, whose
    code is so long that the method of a whole stage was not compiled (HotSpot leaves out methods over 8,000 bytes)."""
    m = F.col(cat_maps) if isinstance(cat_maps, str) else cat_maps
    one = [F.try_element_at(m, F.lit(j)) for j in range(n_channels)]
    return [x.alias(f"_map{j}") for j, x in enumerate(one)] + [
        F.when(x.isNotNull(), F.size(x).cast("double")).alias(f"_size{j}") for j, x in enumerate(one)]


def apply_category_columns(features: Column | str = "features", n_channels: int = N_CHANNELS) -> list[Column]:
    """P8 with the columns of ``category_columns``: the elements of ``apply_categories``, of which the caller makes
    columns, as scoring reads them without an array."""
    f = F.col(features) if isinstance(features, str) else features

    def one(j):
        x = F.get(f, F.lit(j))
        return F.coalesce(F.try_element_at(F.col(f"_map{j}"), x), F.col(f"_size{j}"), x)
    return [one(j) for j in range(n_channels)]


# ------------------------------------------------------------- indexed rows

def indexed_frame(frame: DataFrame, spec: DataFrame, train_percent: int = TRAIN_PERCENT,
                  max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                  broadcast: bool | None = None) -> DataFrame:
    """P7 + P8 + split: labels (fitted order), label_idx, features_idx (its elements also as x0, x1 ...), is_train on
    valid packets."""
    side = spec.select("calibrationid", "labels", *category_columns("cat_maps"))
    j = join_small(frame.where("valid"), side, "calibrationid", "inner", max_broadcast_rows,
                   broadcast)
    x = apply_category_columns("features")
    j = j.select(
        "pk", "calibrationid", "userid", "label", "features", "labels",
        encode("label", "labels").alias("label_idx"), *[c.alias(f"x{i}") for i, c in enumerate(x)],
        is_train("pk", train_percent).alias("is_train"),
    )
    return j.withColumn("features_idx", F.array(*[f"x{i}" for i in range(len(x))]))



# ------------------------------------------------------- fit pass (one scan)

def fit_pass(frame: DataFrame, profile: DataFrame, max_categories: int = MAX_CATEGORIES,
             n_channels: int = N_CHANNELS, train_percent: int = TRAIN_PERCENT,
             broadcast: bool | None = None) -> DataFrame:
    """One aggregation over the valid packets that yields everything training needs.

    Each packet contributes one item for itself (channel = -1: row count, raw
    per-channel sums and minima) and one item per candidate channel of its
    session (channel = j, value = x_j: a count). Grouped by (calibrationid,
    label, is_train, channel, value) with map-side partial aggregation, the
    output has a handful of rows per session: the channel = -1 rows are the
    per-class sufficient statistics, and the candidate rows give the exact
    distinct values (category maps) and the per-class counts of each value.
    """
    cand = channel_candidates(profile, max_categories)
    j = join_small(frame.where("valid"), cand, "calibrationid", "inner", broadcast=broadcast)
    rows = j.select("calibrationid", "label", is_train("pk", train_percent).alias("is_train"), "cand",
                    *[F.element_at("features", i + 1).alias(f"x{i}") for i in range(n_channels)])
    # items are unrolled over the channels, as lambdas would be interpreted; an item of no candidate is NULL.
    # The packet's values stay beside the items, and are taken for its own item only
    items = [F.struct(F.lit(-1).alias("channel"), F.lit(None).cast("double").alias("value"))]
    items += [F.when(F.array_contains("cand", i), F.struct(
        F.lit(i).alias("channel"), (F.col(f"x{i}") + F.lit(0.0)).alias("value"))) for i in range(n_channels)]
    rows = rows.select("calibrationid", "label", "is_train", *[f"x{i}" for i in range(n_channels)],
                       F.inline(F.array(*items))).where(F.col("channel").isNotNull())
    own = lambda i: F.when(F.col("channel") == -1, F.col(f"x{i}"))
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(own(i)).alias(f"s{i}") for i in range(n_channels)]
    aggs += [F.min(own(i)).alias(f"m{i}") for i in range(n_channels)]
    return rows.groupBy("calibrationid", "label", "is_train", "channel", "value").agg(*aggs)


def categories_from_fit_pass(summary: DataFrame, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """A3 from the fit pass: (calibrationid, channel, value, code) for categorical channels."""
    distinct = summary.where(F.col("channel") >= 0).select("calibrationid", "channel", "value").distinct()
    n = distinct.groupBy("calibrationid", "channel").agg(F.count(F.lit(1)).alias("n_values"))
    cat = n.where(F.col("n_values") <= max_categories).select("calibrationid", "channel")
    vals = distinct.join(cat, ["calibrationid", "channel"], "left_semi")
    w = Window.partitionBy("calibrationid", "channel").orderBy(
        (F.col("value") != 0.0).asc(), F.col("value").asc())
    return vals.withColumn("code", (F.dense_rank().over(w) - 1).cast("double"))


def class_statistics(summary: DataFrame, codes: DataFrame, labels: DataFrame,
                     n_channels: int = N_CHANNELS) -> DataFrame:
    """Per (calibrationid, label_idx) over the training side: n, sums of the indexed features, bad.

    A categorical channel's sum is Σ_value count × code (exact); a continuous
    channel's is the raw sum. ``bad`` marks a negative continuous channel
    value (the re-coded categorical channels are never negative).
    """
    train = summary.where(F.col("is_train"))
    own = train.where(F.col("channel") == -1)
    # per (calibrationid, label) the categorical channels' code sums, as channel -> sum
    cat_sum = (train.where(F.col("channel") >= 0)
               .join(codes, ["calibrationid", "channel", "value"])
               .groupBy("calibrationid", "label", "channel")
               .agg(F.sum(F.col("n") * F.col("code")).alias("cs"))
               .groupBy("calibrationid", "label")
               .agg(F.map_from_entries(F.collect_list(F.struct("channel", "cs"))).alias("csum")))
    is_cat = codes.select("calibrationid", "channel").distinct().groupBy("calibrationid").agg(
        F.collect_set("channel").alias("cat_channels"))
    s = (own.join(cat_sum, ["calibrationid", "label"], "left")
         .join(is_cat, "calibrationid", "left")
         .join(labels.select("calibrationid", "labels"), "calibrationid"))
    cats = F.coalesce(F.col("cat_channels"), F.array().cast("array<int>"))
    sums = [F.when(F.array_contains(cats, i), F.coalesce(F.col("csum")[i], F.lit(0.0)))
            .otherwise(F.col(f"s{i}")).alias(f"s{i}") for i in range(n_channels)]
    bad = F.greatest(*[F.when(~F.array_contains(cats, i) & (F.col(f"m{i}") < 0), 1).otherwise(0)
                       for i in range(n_channels)])
    return s.select("calibrationid", encode("label", "labels").alias("label_idx"), "n", *sums,
                    bad.alias("bad"))
