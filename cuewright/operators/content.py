"""What was said against what should have been said; scripts cut into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from ..functions import korean, text as X
from ..functions.numeric import finite


def phrase_table(scripts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Phrase rows of each script with their position, after respelling.

    A worker gives rows back every million characters, so it never holds the
    phrases of a whole Arrow batch.
    """
    spoken = scripts.select(*keys, X.respell(F.col(text)).alias("_spoken"))
    schema = T.StructType([*spoken.schema.fields[:-1], T.StructField("phrase_idx", T.IntegerType()), *korean.PHRASE_TYPE.fields])
    names, fields = schema.names, len(keys)
    return spoken.mapInArrow(lambda batches: korean.phrase_batches(batches, fields, names), schema)


def make_phrase_udtf():
    """The same as a table function for SQL: ``SELECT * FROM cut_phrases(TABLE(scripts), 'text')``.

    It takes a table and the name of its text column and returns the table's other
    columns with ``phrase_idx, text, sentence_final, forced``, whatever their
    types. Rows stay in the partitions in which they come.
    """

    @udtf
    class CutPhrases:
        @staticmethod
        def analyze(scripts: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
            fields = scripts.dataType.fields
            if column.value not in [f.name for f in fields]:
                raise ValueError(f"the table has no column {column.value}")
            made = T.StructType([f for f in fields if f.name != column.value])
            made = made.add("phrase_idx", T.IntegerType()).add("text", T.StringType())
            return AnalyzeResult(made.add("sentence_final", T.BooleanType()).add("forced", T.BooleanType()))

        def eval(self, row: T.Row, column: str):
            kept = [row[c] for c in row.__fields__ if c != column]
            for i, phrase in enumerate(korean.phrase_rows(row[column] or "")):
                yield (*kept, i, *phrase)

    return CutPhrases


def batch_items(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Numbered sentence rows (S0001, ...) of each text."""
    return docs.select(*keys, F.posexplode(X.batch_lines(F.col(text))).alias("_i", "text")).select(
        *keys, F.format_string("S%04d", F.col("_i") + 1).alias("item_id"), "text"
    )


def compare(pairs: DataFrame, tokens=korean.normal_tokens) -> DataFrame:
    """Alignment counts, missing terms, repetitions and continuation per row.

    ``pairs``: expected, actual. Only tokenisation and the
    alignment counts run in Arrow UDFs; the rest are array expressions.
    """
    t = pairs.withColumns({"exp": tokens(F.col("expected")), "act": tokens(F.col("actual"))})
    t = t.withColumn("_al", korean.align("exp", "act"))
    return t.select(
        *pairs.columns, "exp", "act", "_al.*",
        (F.col("_al.distance") / F.greatest(F.lit(1), F.size("exp"))).alias("normalized_edit_distance"),
        X.repetitions(F.col("exp"), F.col("act")).alias("repetitions"),
        X.continues(F.col("exp"), F.col("act")).alias("unexpected_continuation"),
    )


def missing_terms(df: DataFrame, terms: str = "critical_terms", tokens: str = "act", normal=korean.normalise_each) -> DataFrame:
    """Adds the critical terms that do not occur as whole-token runs once normalised.

    Pass ``normal=None`` where the terms already are in normal form; the whole
    check then stays in built-in functions.
    """
    forms = F.col(terms) if normal is None else normal(F.col(terms))
    both = F.transform(
        F.arrays_zip(F.col(terms).alias("term"), forms.alias("form")),
        lambda t: F.struct(t["term"].alias("term"), F.filter(F.split(t["form"], f"{X.WS}+"), lambda w: w != "").alias("words")),
    )
    absent = F.filter(both, lambda t: ~X.contains_term(F.col(tokens), t["words"]))
    return df.withColumn("missing_terms", F.transform(absent, lambda t: t["term"]))


def content_gate(compared: DataFrame) -> DataFrame:
    """Status and reasons; an ASR status other than pass is passed through."""
    ran = F.col("asr_status") == "pass"
    why = F.array_compact(
        F.array(
            F.when(F.col("distance") > 0, F.lit("content_mismatch")),
            F.when(F.size("missing_terms") > 0, F.lit("critical_term_missing")),
            F.when(F.size("repetitions") > 0, F.lit("unexpected_repetition")),
            F.when(F.col("unexpected_continuation"), F.lit("unexpected_continuation")),
        )
    )
    return compared.withColumns(
        {
            "reasons": F.when(ran, why).otherwise(F.array(F.coalesce("asr_reason", F.lit("asr_not_available")))),
            "status": F.when(~ran, F.col("asr_status")).when(F.size(why) > 0, "fail").otherwise("pass"),
        }
    )


def asr_segments(df: DataFrame, keys: list[str], segments: str = "segments") -> DataFrame:
    """Usable segments: some text, both times known, end not before start."""

    def usable(s: Column) -> Column:
        return (
            (X.strip(F.coalesce(s["text"], F.lit(""))) != "")
            & finite(s["start"]).isNotNull() & finite(s["end"]).isNotNull() & (s["end"] >= s["start"])
        )

    kept = F.filter(F.col(segments), usable)
    return df.select(*keys, F.posexplode(kept).alias("segment_idx", "_s")).select(
        *keys, "segment_idx", X.strip(F.col("_s.text")).alias("text"), "_s.start", "_s.end"
    )


def word_timing(df: DataFrame, keys: list[str]) -> DataFrame:
    """Word rows only where recognition passed and found words; content verdicts play no part."""
    usable = (F.col("asr_status") == "pass") & (F.size("words") > 0)
    return df.select(*keys, F.inline_outer(F.when(usable, F.col("words"))))


RULE_SCHEMA = "fast-speaker-rules/1"
RULE_KEYS = ("schema_version", "rules_version", "text_replacements")


def active_rules(documents: DataFrame, schema_version: str = RULE_SCHEMA) -> DataFrame:
    """Newest valid rule document; bad ones leave the earlier one in force. At most one row.

    ``documents``: loaded_at, document (JSON text). Replacements keep their order.
    """
    shape = "schema_version string, rules_version string, text_replacements map<string,string>"
    doc = F.from_json("document", T._parse_datatype_string(shape))
    keys = F.json_object_keys("document")
    parsed = documents.withColumn("_d", doc).withColumn("_k", keys)
    entries = F.map_entries("_d.text_replacements")
    version = X.strip(F.coalesce(F.col("_d.rules_version"), F.lit("")))
    valid = (
        F.col("_k").isNotNull()
        & (F.size(F.array_except("_k", F.array(*[F.lit(k) for k in RULE_KEYS]))) == 0)
        & (F.col("_d.schema_version") == schema_version)
        & (version != "")
        & F.col("_d.text_replacements").isNotNull()
        & ~F.exists(entries, lambda e: (e["key"] == "") | e["value"].isNull())
    )
    pairs = F.transform(entries, lambda e: F.struct(e["key"].alias("source"), e["value"].alias("target")))
    return parsed.where(valid).agg(F.max_by(F.struct(version.alias("v"), pairs.alias("r")), "loaded_at").alias("_a")).select(
        F.coalesce(F.col("_a.v"), F.lit("built-in-noop")).alias("rules_version"),
        F.coalesce(F.col("_a.r"), F.array().cast("array<struct<source:string,target:string>>")).alias("replacements"),
    )


def overlay(docs: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """Texts with the active replacements applied. ``rules`` is one row, so it is broadcast."""
    return docs.crossJoin(F.broadcast(rules)).withColumn(text, X.overlay(F.col(text), F.col("replacements"))).drop(
        "replacements"
    )
