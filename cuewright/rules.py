"""Thresholds, names and aliases of the quality rules.

Fixed values: results only agree with published takes when these agree.
"""

from __future__ import annotations

# speaking rate, syllables per second
RATE_TARGET = 6.54
RATE_BAND = (5.6, 7.2)
RATE_BAND_NUMERIC = (4.4, 7.2)
RATE_BAND_QUESTION = (5.2, 7.2)

# end slope, semitones per second: gate band, prior, bonus band
STATEMENT_SLOPE = ((-35.0, 8.0), -12.0, (-35.0, 0.0))
QUESTION_SLOPE = ((-10.0, -5.0), -6.5, (-10.0, -5.0))
FORCED_SLOPE = ((-8.0, 4.0), -2.0, (-8.0, 4.0))
FINAL_SLOPE_CEILING = -2.0

# fall of the tail
TAIL_DELTA_MAX = -1.5
TAIL_RELATIVE_MAX = -0.28
QUESTION_TAIL_BAND = (-4.0, -1.5)
QUESTION_RELATIVE_BAND = (-0.40, -0.25)

# release at the end of a sentence
FINAL_GLIDE_MIN = 4.0
FINAL_REBOUND_MIN = 2.5

RANGE_BAND = (4.0, 15.0)
LEVEL_ANCHOR_HZ = 235.0
LEVEL_BAND_ST = 2.0

# quality weights
RATE_WEIGHT = 8.0
SLOPE_WEIGHT = 0.5
SLOPE_DISTANCE_CAP = 25.0
SLOPE_BONUS = 5.0
LEVEL_WEIGHT = 6.0
REBOUND_WEIGHT = 4.0
GLIDE_WEIGHT = 0.3

# sequence assembly
BLOCK_MEDIAN_BAND = (-20.0, -5.0)
RESET_BAND = (-4.0, 13.0)
RESET_TARGET = 4.65
RESET_MISS_PENALTY = 30.0
RESET_WEIGHT = 1.2
BEAM_WIDTH = 3
CANDIDATES_PER_PHRASE = 4
PAUSE_CONTINUE = (0.00, 0.02)
PAUSE_FINAL = (0.38, 0.60)
PAUSE_FORCED = (0.05, 0.10)
BLOCK_GAP_SECONDS = 0.5

# take budget
POOL_STATEMENT = 6
POOL_QUESTION = 10
POOL_FORCED = 10
ESCALATION_TAKES = 6
ESCALATION_ROUNDS = 3
EARLY_STOP_MIN_TAKES = 3
EARLY_STOP_MIN_PASSING = 2
EARLY_STOP_QUALITY = -3.0

# text
NUMERAL_CHARS = "영일이삼사오육칠팔구십백천만조"
QUESTION_ENDINGS = ("까요", "나요", "가요")
MIN_SYLLABLES, MAX_SYLLABLES, JOIN_SYLLABLES = 7, 22, 14
CONNECTIVE_ENDINGS = ("고", "서", "며", "면", "데", "만", "져", "쳐", "라", "니", "다")
LOCATIVE_ENDING = "에서"
GOOD_CUT_ENDINGS = ("어", "아", "고", "서", "며", "면", "지", "게", "다", "과", "와", "처럼")
BAD_CUT_ENDINGS = ("한", "된", "진", "인", "에서")
RESPELLINGS = (
    ("굳힌다는", "구친다는"),
    ("굳힌다", "구친다"),
    ("끊깁니다", "끈킵니다"),
    ("끊기는", "끈키는"),
    ("끊어져", "끄너져"),
    ("끊어진", "끄너진"),
    ("끊깁", "끈킵"),
)

# ranking features, in model order, with the names they go by in older rows
FEATURE_VERSION = "preference-features/1"
FEATURE_ALIASES = {
    "syllables_per_second": ("syllables_per_second", "syllables_per_sec", "rate"),
    "pitch_median_hz": ("pitch_median_hz", "median_hz"),
    "pitch_range_st": ("pitch_range_st", "range_st"),
    "tail_delta_st": ("tail_delta_st", "tail_delta"),
    "relative_tail": ("relative_tail",),
    "final_glide_st_per_s": ("final_glide_st_per_s", "final_glide"),
    "final_rebound_st": ("final_rebound_st", "final_rebound"),
    "level_deviation_db": ("level_deviation_db", "level_deviation"),
    "phrase_reset_st": ("phrase_reset_st", "phrase_reset"),
    "speaker_similarity_chatterbox": ("speaker_similarity_chatterbox", "speaker_primary_score"),
    "speaker_similarity_speechbrain": ("speaker_similarity_speechbrain", "speaker_secondary_score"),
    "content_score": ("content_score", "content_similarity"),
    "content_error_rate": ("content_error_rate", "cer"),
    "mos_score": ("mos_score", "speechmos", "mos"),
}
FEATURE_NAMES = tuple(FEATURE_ALIASES)

# ranker
MODEL_VERSION = "pairwise-logistic/1"
ARTIFACT_SCHEMA_VERSION = "ranker-artifact/1"
L2 = 0.02
MOS_L2_MULTIPLIER = 8.0
SPLIT_SEED = 407
TEST_FRACTION = 0.25
CONFIDENCE_THRESHOLD = 0.20
MIN_PINNED, MIN_PAIRS, MIN_BLOCKS, RECOMMENDED_PROJECTS = 50, 150, 5, 2

STATUSES = ("pass", "fail", "unknown", "not_run")

# Thresholds of the audio sanity check.
SANITY = {
    "config_version": "1",
    "expected_sample_rate_hz": 24000,
    "minimum_duration_seconds": 0.10,
    "silence_threshold_dbfs": -60.0,
    "maximum_leading_silence_seconds": 1.50,
    "maximum_trailing_silence_seconds": 1.50,
    "maximum_internal_silence_seconds": 0.75,
    "peak_guard": 0.89,
    "maximum_clipping_ratio": 0.001,
    "maximum_dc_offset": 0.02,
    "abrupt_end_window_seconds": 0.005,
    "abrupt_end_max_rms_dbfs": -25.0,
    "tail_window_seconds": 0.50,
    "maximum_tail_seconds": 1.50,
}
