"""From a logit to a verdict, and from a verdict to what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.calibration import Calibration, abstains, energy, probability
from ..schemas import RELIABILITY_FIELDS
from .numeric import c, half_up, sigmoid

# Texts and limits of the product contract.
NO_FACE_WARNING = (
    "No face was detected, so the visual stream scored centre crops. Treat this result as unreliable."
)
DEGENERATE_WARNING = (
    "This model's probability calibration was fitted on too little validation data, so the percentage shown "
    "is not trustworthy. Treat the verdict as indicative only."
)
NO_FACE_META = "no face detected in any sampled frame; centre crops stored instead"
NO_AUDIO_META = "no usable audio stream; audio+sync streams masked off"
DEFAULT_DETECTOR_THRESHOLDS = "(0.6, 0.7, 0.7)"
STAGES = ["queued", "probe", "preprocess", "infer", "calibrate", "explain", "persist", "done"]


def ood_flag(energy_score, cut: float | None) -> Column:
    return F.lit(False) if cut is None else c(energy_score) > F.lit(cut)


def verdict(prob, abstain, ood, threshold) -> Column:
    """Three states: inconclusive first, then manipulated at or above the threshold."""
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (
        F.when(c(abstain) | c(ood), "inconclusive")
        .when(c(prob) >= thr, "likely_manipulated")
        .otherwise("likely_authentic")
    )


def is_confident(verdict_col="verdict", ood="ood_flag") -> Column:
    return (c(verdict_col) != "inconclusive") & ~c(ood)


def score_logits(df: DataFrame, cal: Calibration, logit: str = "logit") -> DataFrame:
    """Stateless scoring of a table or stream of logits.

    The flag always uses the energy score; a Mahalanobis distance in a ``distance``
    column, if there is one, is what gets reported.
    """
    e = energy(logit)
    reported = F.coalesce("distance", e) if "distance" in df.columns else e
    out = df.withColumns(
        {
            "raw_score": sigmoid(logit),
            "calibrated_prob": probability(logit, cal),
            "ood_score": reported,
            "ood_flag": ood_flag(e, cal.ood_threshold),
        }
    )
    out = out.withColumn("abstain", abstains("calibrated_prob", cal))
    return out.withColumn("verdict", verdict("calibrated_prob", "abstain", "ood_flag", cal.threshold))


def job_progress(stage) -> Column:
    """Position of a stage in the fixed order, in [0, 1]; unknown stages count as 0."""
    at = F.array_position(F.lit(STAGES), c(stage))
    return F.when(at > 0, (at - 1) / F.lit(float(len(STAGES) - 1))).otherwise(0.0)


def stream_evidence(logits, has_audio, mouth_available, gates) -> Column:
    """One struct per stream that was scored; absent streams leave no entry.

    ``logits`` and ``gates`` are maps from stream name to a number.
    """
    audio = c(has_audio)

    def one(name: str) -> Column:
        z = F.try_element_at(c(logits), F.lit(name))
        usable = F.lit(True) if name == "visual" else audio
        if name == "visual":
            note = F.lit("")
        elif name == "audio":
            note = F.when(~audio, "no audio track; stream masked off").otherwise("")
        else:
            note = (
                F.when(~audio, "no audio track; stream masked off")
                .when(~c(mouth_available), "mouth region not reliably visible")
                .otherwise("")
            )
        return F.when(
            z.isNotNull(),
            F.struct(
                F.lit(name).alias("name"),
                F.when(usable, half_up(sigmoid(z), 5)).alias("score"),
                usable.alias("available"),
                F.coalesce(F.try_element_at(c(gates), F.lit(name)), F.lit(1.0)).alias("reliability"),
                note.alias("note"),
            ),
        )

    return F.array_compact(F.array(one("visual"), one("audio"), one("sync")))


def preprocess_warnings(detector_thresholds, n_faces, audio_usable) -> Column:
    return F.array_compact(
        F.array(
            F.when(
                c(detector_thresholds) != DEFAULT_DETECTOR_THRESHOLDS,
                F.concat(F.lit("non-default detector thresholds "), c(detector_thresholds)),
            ),
            F.when(c(n_faces) == 0, F.lit(NO_FACE_META)),
            F.when(~c(audio_usable), F.lit(NO_AUDIO_META)),
        )
    )


def result_warnings(meta_warnings, degenerate, n_faces) -> Column:
    """Warnings of the preprocessing step followed by those of the scoring step."""
    own = F.array_compact(
        F.array(F.when(c(degenerate), F.lit(DEGENERATE_WARNING)), F.when(c(n_faces) == 0, F.lit(NO_FACE_WARNING)))
    )
    return F.concat(c(meta_warnings), own)


# --------------------------------------------------------------------------
# views of a result row
# --------------------------------------------------------------------------
def segments_of(scores, stamps, threshold) -> Column:
    """Suspicious segments of one result row's frame arrays, as an array of structs.

    A row's arrays are one clip's sampled frames, so this stays inside the row; for
    frame tables use ``operators.clips.segments``. Timestamps that are too few are
    replaced by frame numbers; decreasing ones raise.
    """
    s = F.coalesce(c(scores), F.array().cast("array<double>"))
    n = F.size(s)
    raw = F.coalesce(c(stamps), F.array().cast("array<double>"))
    index = F.transform(s, lambda v, i: i.cast("double"))
    ts = F.when(F.size(raw) >= n, F.slice(raw, 1, F.greatest(n, F.lit(0)))).otherwise(index)
    later = F.slice(ts, 2, F.greatest(n - 1, F.lit(0)))
    gaps = F.zip_with(F.slice(ts, 1, F.greatest(n - 1, F.lit(0))), later, lambda a, b: b - a)
    checked = F.when(
        F.exists(gaps, lambda g: g < 0), F.raise_error(F.lit("frame timestamps must be non-decreasing"))
    ).otherwise(ts)
    positive = F.array_sort(F.filter(gaps, lambda g: g > 0))
    step = F.coalesce(F.try_element_at(positive, (F.size(positive) / 2).cast("int") + 1), F.lit(1.0))
    ends = F.concat(later, F.array(F.try_element_at(checked, F.lit(-1)) + step))
    frames = F.transform(
        F.arrays_zip(checked.alias("t"), ends.alias("e"), s.alias("s")),
        lambda f, i: F.struct(f["t"].alias("t"), f["e"].alias("e"), f["s"].alias("s"), i.alias("i")),
    )
    empty = F.array().cast(
        "array<struct<start_s:double,end_s:double,peak_score:double,peak_time_s:double,"
        "n_frames:int,first:int,open:boolean>>"
    )

    def close(segs: Column) -> Column:
        return F.transform(segs, lambda g: g.withField("open", F.lit(False)))

    def step_over(segs: Column, f: Column) -> Column:
        last = F.try_element_at(segs, F.lit(-1))
        fresh = F.struct(
            f["t"].alias("start_s"), f["e"].alias("end_s"), f["s"].alias("peak_score"), f["t"].alias("peak_time_s"),
            F.lit(1).alias("n_frames"), f["i"].alias("first"), F.lit(True).alias("open"),
        )
        higher = f["s"] > last["peak_score"]
        grown = F.struct(
            last["start_s"].alias("start_s"),
            f["e"].alias("end_s"),
            F.when(higher, f["s"]).otherwise(last["peak_score"]).alias("peak_score"),
            F.when(higher, f["t"]).otherwise(last["peak_time_s"]).alias("peak_time_s"),
            (f["i"] - last["first"] + 1).alias("n_frames"),
            last["first"].alias("first"),
            F.lit(True).alias("open"),
        )
        hit = f["s"] >= c(threshold)
        joins = last.isNotNull() & (last["open"] | (f["t"] - last["end_s"] <= 0))
        return (
            F.when(~hit, close(segs))
            .when(joins, F.concat(F.slice(segs, 1, F.size(segs) - 1), F.array(grown)))
            .otherwise(F.concat(close(segs), F.array(fresh)))
        )

    folded = F.aggregate(frames, empty, step_over)
    return F.transform(
        F.when(n > 0, folded).otherwise(empty),
        lambda g: F.struct(
            half_up(g["start_s"], 3).alias("start_s"),
            half_up(g["end_s"], 3).alias("end_s"),
            half_up(g["peak_score"], 4).alias("peak_score"),
            half_up(g["peak_time_s"], 3).alias("peak_time_s"),
            g["n_frames"].alias("n_frames"),
        ),
    )


def summary(results: DataFrame) -> DataFrame:
    """The flat, thirteen-column row per result."""
    segs = segments_of("frame_scores", "frame_timestamps", "threshold")
    return results.select(
        "video_id",
        "verdict",
        half_up("calibrated_prob", 4).alias("calibrated_prob"),
        "conformal_lo",
        "conformal_hi",
        "threshold",
        "ood_flag",
        (~F.coalesce("calibration_degenerate", F.lit(False))).alias("calibration_reliable"),
        "has_audio",
        "n_faces_found",
        F.size(segs).alias("n_suspicious_segments"),
        F.coalesce(F.array_max("frame_scores"), F.lit(0.0)).alias("peak_frame_score"),
        F.when(F.col("warnings").isNull(), 0).otherwise(F.size("warnings")).alias("n_warnings"),
        F.coalesce("model_version", F.lit("")).alias("model_version"),
    )


def public_result(results: DataFrame) -> DataFrame:
    """The public response: stable outer names over the internal result."""
    return results.select(
        "video_id",
        "verdict",
        half_up("calibrated_prob", 4).alias("calibrated_probability"),
        F.array("conformal_lo", "conformal_hi").alias("confidence_interval"),
        F.col("threshold").alias("decision_threshold"),
        (F.col("verdict") == "inconclusive").alias("abstained"),
        "ood_flag",
        (~F.coalesce("calibration_degenerate", F.lit(False))).alias("calibration_reliable"),
        "warnings",
        "streams",
        "frame_scores",
        "frame_timestamps",
        "sync_curve",
        segments_of("frame_scores", "frame_timestamps", "threshold").alias("suspicious_segments"),
        "gate_weights",
        "reliability",
        "has_audio",
        "n_faces_found",
        "explanation",
        F.coalesce("explanation_source", F.lit("none")).alias("explanation_source"),
        F.coalesce("model_version", F.lit("")).alias("model_version"),
        "latency_ms",
    )


def explain_payload(results: DataFrame) -> DataFrame:
    """Every value a written explanation may draw on, as the struct ``payload``."""
    top = F.array_max("frame_scores")
    peak = F.array_position("frame_scores", top) - 1
    mean = F.aggregate("sync_curve", F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size("sync_curve"), F.lit(0))
    fields = [
        F.col("verdict"),
        half_up("calibrated_prob", 4).alias("calibrated_probability"),
        F.array("conformal_lo", "conformal_hi").alias("conformal_band"),
        F.col("threshold").alias("decision_threshold"),
        (F.col("verdict") == "inconclusive").alias("abstained"),
        F.col("ood_flag"),
        F.col("has_audio"),
        F.col("n_faces_found"),
        F.size("frame_scores").alias("n_frames_scored"),
        half_up(F.array_min("frame_scores"), 4).alias("frame_score_min"),
        half_up(top, 4).alias("frame_score_max"),
        peak.alias("peak_frame_index"),
        F.when(peak >= 0, F.try_element_at("frame_timestamps", (peak + 1).cast("int"))).alias("peak_frame_time_s"),
        half_up(mean, 4).alias("sync_curve_mean"),
        F.col("sync_offset_ms"),
        F.transform("streams", lambda s: s.withField("reliability", half_up(s["reliability"], 3))).alias("streams"),
        F.col("gate_weights"),
        F.create_map(
            *[x for k in RELIABILITY_FIELDS for x in (F.lit(k), F.try_element_at("reliability", F.lit(k)))]
        ).alias("reliability"),
        F.col("warnings"),
        F.col("model_version"),
    ]
    return results.select("video_id", F.struct(*fields).alias("payload"))
