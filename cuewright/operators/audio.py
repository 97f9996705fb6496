"""Sanity of sample data, loudness plans, and speaker similarity."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.numeric import finite
from ..functions.vectors import cosine
from .ordered import Hot, previous_row


class SanityConfig:
    """Thresholds of the sanity check: the fixed values of ``rules.SANITY``, some of them replaced."""

    def __init__(self, **changes):
        unknown = changes.keys() - R.SANITY.keys()
        if unknown:
            raise TypeError(f"no such threshold: {sorted(unknown)}")
        self.values = R.SANITY | changes

    def __getattr__(self, name: str):
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def config_hash(self) -> str:
        """One tag per set of values, whatever their order."""
        return hashlib.sha256(json.dumps(self.values, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    @staticmethod
    def config_hash_of(**changes: Column) -> Column:
        """The tag of a configuration whose replaced thresholds are columns; equal values give the tag of ``config_hash``."""
        fields = [changes.get(n, F.lit(v)).alias(n) for n, v in sorted(R.SANITY.items())]
        return F.sha2(F.to_json(F.struct(*fields)), 256)

    @property
    def silence_amplitude(self) -> float:
        return 10.0 ** (self.values["silence_threshold_dbfs"] / 20.0)


BLOCK_SAMPLES = 65536


def wav_layout(content: bytes) -> tuple[int, int, int, int, int]:
    """(rate, channels, width, first byte, bytes of samples) of a PCM WAV; ValueError for anything else."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not_wave")
    at, fmt, data = 12, None, None
    while at + 8 <= len(content):
        tag, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        if tag == b"fmt ":
            fmt = content[at + 8 : at + 8 + size]
        elif tag == b"data":
            if len(content) - at - 8 < size:
                raise ValueError("truncated")
            data = at + 8, size
        at += 8 + size + (size & 1)
    if fmt is None or data is None or len(fmt) < 16:
        raise ValueError("incomplete")
    code, channels = int.from_bytes(fmt[0:2], "little"), int.from_bytes(fmt[2:4], "little")
    rate, bits = int.from_bytes(fmt[4:8], "little"), int.from_bytes(fmt[14:16], "little")
    width = bits // 8
    if code not in (1, 0xFFFE):
        raise ValueError("compressed")
    if channels < 1 or width not in (1, 2, 3, 4) or not data[1]:
        raise ValueError("unsupported")
    if data[1] % (channels * width):
        raise ValueError("truncated")
    return rate, channels, width, *data


def mono_samples(raw: memoryview, channels: int, width: int) -> np.ndarray:
    """Channel means of whole frames as numbers between -1 and 1."""
    raw = np.frombuffer(raw, dtype=np.uint8)
    if width == 1:
        values = (raw.astype(np.float64) - 128.0) / 128.0
    else:
        # little-endian bytes into the top of an int32: the sign comes along for every width
        padded = np.zeros((len(raw) // width, 4), dtype=np.uint8)
        padded[:, 4 - width :] = raw.reshape(-1, width)
        values = padded.reshape(-1).view("<i4") / 2.0**31
    return values.reshape(-1, channels).mean(axis=1)


DECODED = (
    "path string, sample_rate_hz int, channels int, sample_width int, start bigint, samples array<double>, decode_error string"
)


def decode(files: DataFrame) -> DataFrame:
    """Mono samples of WAV files in blocks, or one row with the decode error.

    The header is read once; samples are decoded and handed on block by block, so
    beside the bytes of one file a task holds the samples of one block.

    ``files``: path, content (as from Spark's binaryFile source).
    """

    def run(batches: Iterable[pd.DataFrame]):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rate, channels, width, first, size = wav_layout(content)
                except ValueError as exc:
                    yield pd.DataFrame([(path, None, None, None, 0, None, str(exc))], columns=_names())
                    continue
                frame, view = channels * width, memoryview(content)
                for start in range(0, size // frame, BLOCK_SAMPLES):
                    stop = min(size, (start + BLOCK_SAMPLES) * frame)
                    mono = mono_samples(view[first + start * frame : first + stop], channels, width)
                    yield pd.DataFrame([(path, rate, channels, width, start, mono, None)], columns=_names())

    def _names():
        return [c.strip().split(" ")[0] for c in DECODED.split(",")]

    return files.select("path", "content").mapInPandas(run, DECODED)


def to_samples(decoded: DataFrame) -> DataFrame:
    """One row per sample: path, rate, i, x."""
    ok = decoded.where("decode_error IS NULL")
    return ok.select("path", "sample_rate_hz", "start", F.posexplode("samples").alias("_p", "x")).select(
        "path", "sample_rate_hz", (F.col("start") + F.col("_p")).alias("i"), "x"
    )


def _dbfs(c: Column) -> Column:
    return F.lit(20.0) * F.log10(F.greatest(c, F.lit(1e-12)))


def stats(
    samples: DataFrame, config: SanityConfig = SanityConfig(), key: str = "path", hot: Hot = None
) -> DataFrame:
    """Level, clipping, offset and silence measures per signal.

    ``samples``: key, sample_rate_hz, i (0-based, dense), x. Two aggregates and a
    chunked lag over the active samples: one endless signal spreads over tasks.
    """
    x = F.col("x").cast("double")
    bad = F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull()
    active = F.abs(x) > config.silence_amplitude
    whole = samples.groupBy(key).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.max("sample_rate_hz").alias("sample_rate_hz"),
        (~F.bool_or(bad)).alias("finite"),
        F.max(F.abs(x)).alias("peak"),
        F.sqrt(F.avg(x * x)).alias("rms"),
        F.avg(F.when(F.abs(x) >= 0.999, 1.0).otherwise(0.0)).alias("clipping_ratio"),
        F.avg(x).alias("dc_offset"),
        F.min(F.when(active, F.col("i"))).alias("_first"),
        F.max(F.when(active, F.col("i"))).alias("_last"),
    )
    window = F.greatest(F.lit(1), F.bround(F.lit(config.abrupt_end_window_seconds) * F.col("sample_rate_hz")))
    end = samples.join(whole.select(key, "sample_count", window.alias("_w")), key).where(
        F.col("i") >= F.col("sample_count") - F.col("_w")
    ).groupBy(key).agg(F.sqrt(F.avg(x * x)).alias("end_rms"))
    loud = previous_row(
        samples.where(active).select(key, "i"), [key], ["i"], [F.floor(F.col("i") / BLOCK_SAMPLES)], {"_prev": "i"}, hot
    )
    gaps = loud.groupBy(key).agg(F.max(F.col("i") - F.col("_prev") - 1).alias("_gap"))
    joined = whole.join(end, key, "left").join(gaps, key, "left")
    rate = F.col("sample_rate_hz")
    silent = F.col("_first").isNull()
    trailing = F.when(silent, F.col("sample_count")).otherwise(F.col("sample_count") - 1 - F.col("_last")) / rate
    measured = {
        "duration_seconds": F.col("sample_count") / rate,
        "zero_waveform": F.col("peak") == 0.0,
        "peak": F.col("peak"),
        "peak_dbfs": _dbfs(F.col("peak")),
        "rms": F.col("rms"),
        "rms_dbfs": _dbfs(F.col("rms")),
        "crest_factor_db": F.when(F.col("rms") > 0, _dbfs(F.col("peak") / F.nullif(F.col("rms"), F.lit(0.0)))).otherwise(
            F.lit(float("inf"))
        ),
        "clipping_ratio": F.col("clipping_ratio"),
        "dc_offset": F.col("dc_offset"),
        "leading_silence_seconds": F.when(silent, F.col("sample_count")).otherwise(F.col("_first")) / rate,
        "trailing_silence_seconds": trailing,
        "longest_internal_silence_seconds": F.coalesce("_gap", F.lit(0)) / rate,
        "end_window_rms_dbfs": _dbfs(F.col("end_rms")),
        "tail_silence_seconds": trailing,
    }
    return joined.select(
        key, "sample_count", "sample_rate_hz", "finite",
        *[F.when(F.col("finite"), v).alias(n) for n, v in measured.items()],
    )


def gate(measured: DataFrame, config: SanityConfig = SanityConfig()) -> DataFrame:
    """Ordered failure reasons and status."""
    c = F.col
    checks = [
        (c("sample_rate_hz") != config.expected_sample_rate_hz, "unexpected_sample_rate"),
        (c("duration_seconds") < config.minimum_duration_seconds, "file_too_short"),
        (c("zero_waveform"), "zero_waveform"),
        (c("peak") > config.peak_guard, "peak_guard_exceeded"),
        (c("clipping_ratio") > config.maximum_clipping_ratio, "clipping_ratio_exceeded"),
        (F.abs(c("dc_offset")) > config.maximum_dc_offset, "dc_offset_exceeded"),
        (c("leading_silence_seconds") > config.maximum_leading_silence_seconds, "leading_silence_too_long"),
        (c("trailing_silence_seconds") > config.maximum_trailing_silence_seconds, "trailing_silence_too_long"),
        (c("longest_internal_silence_seconds") > config.maximum_internal_silence_seconds, "internal_silence_too_long"),
        (c("tail_silence_seconds") > config.maximum_tail_seconds, "tail_too_long"),
        (c("end_window_rms_dbfs") > config.abrupt_end_max_rms_dbfs, "abrupt_end"),
    ]
    listed = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in checks]))
    why = F.when(F.col("finite"), listed).otherwise(F.array(F.lit("non_finite_samples")))
    return measured.withColumn("reasons", why).withColumn("status", F.when(F.size("reasons") == 0, "pass").otherwise("fail"))


def sanity(expected: DataFrame, decoded: DataFrame, config: SanityConfig = SanityConfig()) -> DataFrame:
    """Status and reasons for every expected path, also missing and undecodable files."""
    gated = gate(stats(to_samples(decoded), config), config).select("path", "reasons", "status")
    broken = decoded.where("decode_error IS NOT NULL").select("path", F.lit(True).alias("_broken")).distinct()
    joined = expected.select("path").join(gated, "path", "left").join(broken, "path", "left")
    return joined.select(
        "path",
        F.when(F.col("_broken"), F.array(F.lit("decode_error")))
        .when(F.col("reasons").isNull(), F.array(F.lit("file_missing")))
        .otherwise(F.col("reasons"))
        .alias("reasons"),
        F.when(F.col("_broken") | F.col("status").isNull(), "fail").otherwise(F.col("status")).alias("status"),
    )


TARGET_RMS = 10.0 ** (-20.0 / 20.0)
PEAK_GUARD = 0.89
FADE_SECONDS = 0.012


def level_plan(segments: DataFrame, track: list[str], rate: int, samples: str = "samples") -> DataFrame:
    """Gain of each segment after its fades, then one guard per track against clipping."""
    n = int(FADE_SECONDS * rate)
    size = F.size(samples)

    def faded(x: Column, i: Column) -> Column:
        up = F.when(i < n, i / float(max(n - 1, 1))).otherwise(1.0)
        back = size - 1 - i
        return x.cast("double") * up * F.when(back < n, back / float(max(n - 1, 1))).otherwise(1.0)

    shaped = segments.withColumn("_f", F.transform(samples, faded))
    energy = F.aggregate("_f", F.lit(0.0), lambda a, x: a + x * x)
    levelled = shaped.withColumn("rms", F.sqrt(energy / F.nullif(size, F.lit(0)))).withColumn(
        "gain", F.lit(TARGET_RMS) / F.greatest(F.coalesce("rms", F.lit(0.0)), F.lit(1e-9))
    ).withColumn("peak", F.array_max(F.transform("_f", lambda x: F.abs(x))) * F.col("gain"))
    loudest = levelled.groupBy(*track).agg(F.max("peak").alias("track_peak"))
    guard = F.when(F.col("track_peak") > PEAK_GUARD, F.lit(PEAK_GUARD) / F.col("track_peak")).otherwise(1.0)
    return levelled.drop("_f").join(loudest, track).withColumn("guard", guard).withColumn(
        "peak_after", F.col("peak") * F.col("guard")
    )


# Calibration groups.
POSITIVE_GROUPS = ("candidate", "approved")
NEGATIVE_GROUP = "rejected"
EXTRA_GROUP = "same_speaker_low_quality"


def similarity(embeddings: DataFrame, reference: DataFrame, vector: str = "embedding") -> DataFrame:
    """Cosine against a single reference vector. The reference is one row, so it is broadcast."""
    one = reference.agg(F.first(vector).alias("_ref"), F.count(F.lit(1)).alias("_n"))
    joined = embeddings.crossJoin(F.broadcast(one))
    known = (F.col("_n") == 1) & F.col(vector).isNotNull()
    return joined.withColumn("similarity", F.when(known, cosine(F.col(vector), F.col("_ref")))).drop("_ref", "_n")


def calibrate(
    scores: DataFrame, group: str = "group", score: str = "primary_score", positives: tuple[str, ...] = POSITIVE_GROUPS,
    negative: str = NEGATIVE_GROUP, extras: tuple[str, ...] = (EXTRA_GROUP,),
) -> DataFrame:
    """One row: threshold between the worst positive and best negative, with error counts and ``n_, min_, max_`` per group."""
    g, s = F.col(group), F.col(score)
    names = (*positives, negative, *extras)
    positive, negative = g.isin(*positives), g == negative
    bounds = scores.agg(
        F.count(F.lit(1)).alias("sample_count"),
        ((F.min(F.when(positive, s)) + F.max(F.when(negative, s))) / 2).alias("_mid"),
        *[F.count_if(g == n).alias(f"n_{n}") for n in names],
        *[F.min(F.when(g == n, s)).alias(f"min_{n}") for n in names],
        *[F.max(F.when(g == n, s)).alias(f"max_{n}") for n in names],
    )
    enough = reduce(lambda a, b: a & b, [F.col(f"n_{n}") > 0 for n in names[: len(positives) + 1]])
    bounds = bounds.withColumn("threshold", F.when(enough, F.col("_mid"))).withColumn(
        "status", F.when(enough, "calibrated_candidate").otherwise("insufficient_data")
    ).drop("_mid")
    errors = scores.crossJoin(F.broadcast(bounds.select("threshold"))).agg(
        F.count_if(negative & (s >= F.col("threshold"))).alias("_fa"),
        F.count_if(positive & (s < F.col("threshold"))).alias("_fr"),
        F.max("threshold").alias("_t"),
    )
    both = bounds.crossJoin(F.broadcast(errors))
    known = F.col("threshold").isNotNull()
    return both.withColumns(
        {"false_accepts": F.when(known, F.col("_fa")), "false_rejects": F.when(known, F.col("_fr"))}
    ).drop("_fa", "_fr", "_t")


def speaker_gate(scored: DataFrame, calibration: DataFrame, score: str = "similarity") -> DataFrame:
    """not_run without a score, unknown without a usable calibration, else by threshold.

    ``calibration`` is one row (status, threshold), so it is broadcast.
    """
    one = calibration.agg(F.max("status").alias("_status"), F.max("threshold").alias("_threshold"))
    limit = finite(F.col("_threshold"))
    usable = F.coalesce((F.col("_status") == "calibrated_candidate") & limit.between(-1.0, 1.0), F.lit(False))
    s = F.col(score)
    return (
        scored.crossJoin(F.broadcast(one))
        .withColumns(
            {
                "hard_gate": usable & s.isNotNull(),
                "status": F.when(s.isNull(), "not_run").when(~usable, "unknown").when(s >= limit, "pass").otherwise("fail"),
                "reason": F.when(s.isNull(), "embedding_not_bound")
                .when(~usable, "insufficient_calibration")
                .when(s < limit, "primary_similarity_below_calibrated_threshold"),
            }
        )
        .drop("_status", "_threshold")
    )
