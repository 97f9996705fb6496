"""The driver tables seen as takes, phrases, pins, events and so on.

Each binding exists twice: as a DataFrame and as a SQL common table expression,
so that a registered query and its SQL twin start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import Hot, hot_keys, number_rows, parts_by_heat


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_HOT: dict = {}


def hot(spark: SparkSession, sf_dir: str, name: str, keys: dict[str, str]) -> list[tuple]:
    """Hot keys of a stored table, looked up once per application.

    ``keys`` maps the names the operators use to expressions over the table.
    """
    at = (spark.sparkContext.applicationId, sf_dir, name, *keys.items())
    if at not in _HOT:
        rows = table(spark, sf_dir, name).select(*[F.expr(e).alias(n) for n, e in keys.items()])
        _HOT[at] = hot_keys(rows, list(keys))
    return _HOT[at]


def hot_orders(spark, sf_dir):
    return hot(spark, sf_dir, "lineitem", {"l_orderkey": "l_orderkey"})


def hot_blocks(spark, sf_dir):
    return hot(spark, sf_dir, "orders", {"project_id": "o_orderpriority", "block_id": "CAST(o_custkey AS STRING)"})


def hot_users(spark, sf_dir, name: str = "user_id"):
    return hot(spark, sf_dir, "events", {name: "user_id"})


def hot_phrases(spark, sf_dir):
    """Hot orders under their full phrase key; a lookup of the few that there are."""
    orders = hot_orders(spark, sf_dir)
    if not orders:
        return orders  # none, or too many to list
    found = [k[0] for k in orders]
    rows = bare_phrases(spark, sf_dir).where(F.col("phrase_id").isin(found))
    return [tuple(r) for r in rows.select("project_id", "block_id", "phrase_id").collect()]


TAKE_COLUMNS = """
  l_orderkey AS phrase_id, take_id, CAST(l_quantity AS INT) AS n_syl,
  l_quantity / (5e0 + 26e0*l_discount) AS dur,
  235e0*pow(2e0, (l_tax-4e-2)*625e-1/12e0) AS median_hz,
  35e-1 + (l_partkey % 120)/1e1 AS range_st,
  CAST(-36 + (l_suppkey % 46) AS DOUBLE) AS end_slope,
  CASE WHEN l_returnflag='N' THEN NULL ELSE -4e0 + (l_partkey % 50)/1e1 END AS tail_delta,
  CASE WHEN l_returnflag='N' THEN NULL ELSE (l_suppkey % 17) - 45e-1 END AS final_glide,
  CASE WHEN l_returnflag='N' THEN NULL ELSE (l_suppkey % 13)/2e0 END AS final_rebound,
  235e0*pow(2e0, ((l_partkey % 13)-363e-2)/12e0) AS first_hz,
  235e0*pow(2e0, ((l_suppkey % 9)-6)/12e0) AS last_hz,
  l_linestatus='F' AS numeric_heavy, l_shipdate AS generated_at, -l_extendedprice AS baseline_score,
  l_linenumber AS line, l_partkey AS part, l_suppkey AS supp
"""

PHRASE_COLUMNS = """
  o_orderpriority AS project_id, CAST(o_custkey AS STRING) AS block_id, o_orderkey AS phrase_id,
  o_orderstatus='F' AS sentence_final, o_orderstatus='P' AS forced, o_orderkey % 7 = 0 AS question
"""

TAKES_SQL = f"""
raw_takes AS (
  SELECT {TAKE_COLUMNS} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS take_id FROM lineitem) q),
bare_phrases AS (SELECT {PHRASE_COLUMNS}, sha256(CAST(o_orderkey % 997 AS STRING)) AS text_hash FROM orders),
takes AS (SELECT t.*, p.project_id, p.block_id, p.sentence_final, p.forced, p.question, p.text_hash
  FROM raw_takes t JOIN bare_phrases p ON p.phrase_id = t.phrase_id)"""

PHRASES_SQL = """
phrases AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id, block_id ORDER BY phrase_id)-1 AS INT) AS phrase_idx
  FROM bare_phrases)"""

PINS_SQL = """
pins AS (SELECT project_id, block_id, phrase_id, CAST(phrase_id % 3 AS INT) AS take_id FROM bare_phrases WHERE phrase_id % 4 = 0)"""

RATE = "(CASE WHEN dur > 0 THEN n_syl/dur ELSE 0e0 END)"
REL = "(CASE WHEN range_st > 0 THEN tail_delta/range_st ELSE 0e0 END)"
LEVEL = "(12e0*log2(median_hz/235e0))"
LOW = "(CASE WHEN question THEN -10e0 WHEN forced THEN -8e0 ELSE -35e0 END)"
HIGH = "(CASE WHEN question THEN -5e0 WHEN forced THEN 4e0 ELSE 8e0 END)"
PRIOR = "(CASE WHEN question THEN -65e-1 WHEN forced THEN -2e0 ELSE -12e0 END)"
BONUS_HIGH = "(CASE WHEN question THEN -5e0 WHEN forced THEN 4e0 ELSE 0e0 END)"
QUALITY = f"""(-8e0*abs(n_syl/dur-654e-2) - 5e-1*least(abs(end_slope-{PRIOR}), 25e0)
  + CASE WHEN end_slope BETWEEN {LOW} AND {BONUS_HIGH} THEN 5e0 ELSE 0e0 END - 6e0*abs({LEVEL})
  - CASE WHEN sentence_final THEN coalesce(greatest(25e-1-final_rebound, 0e0), 0e0)*4e0
      + coalesce(greatest(4e0-final_glide, 0e0), 0e0)*3e-1 ELSE 0e0 END)"""
WHY = f"""rtrim(concat(
  CASE WHEN {RATE} < (CASE WHEN question THEN 52e-1 WHEN numeric_heavy THEN 44e-1 ELSE 56e-1 END) OR {RATE} > 72e-1 THEN 'rate,' ELSE '' END,
  CASE WHEN question AND sentence_final AND (tail_delta < -4e0 OR tail_delta > -15e-1) THEN 'q_tail,' ELSE '' END,
  CASE WHEN question AND sentence_final AND tail_delta IS NOT NULL AND ({REL} < -4e-1 OR {REL} > -25e-2) THEN 'q_rel,' ELSE '' END,
  CASE WHEN NOT (question AND sentence_final AND tail_delta IS NOT NULL) AND (end_slope < {LOW} OR end_slope >
     (CASE WHEN sentence_final AND NOT question THEN least({HIGH}, -2e0) ELSE {HIGH} END)) THEN 'end_slope,' ELSE '' END,
  CASE WHEN sentence_final AND NOT question AND tail_delta > -15e-1 THEN 'tail,' ELSE '' END,
  CASE WHEN sentence_final AND NOT question AND tail_delta IS NOT NULL AND {REL} > -28e-2 THEN 'rel_fall,' ELSE '' END,
  CASE WHEN sentence_final AND final_glide < 4e0 THEN 'glide,' ELSE '' END,
  CASE WHEN sentence_final AND final_rebound < 25e-1 THEN 'rebound,' ELSE '' END,
  CASE WHEN range_st < 4e0 OR range_st > 15e0 THEN 'range,' ELSE '' END,
  CASE WHEN abs({LEVEL}) > 2e0 THEN 'level,' ELSE '' END), ',')"""
SCORED_SQL = f"scored AS (SELECT *, why = '' AS ok FROM (SELECT *, {WHY} AS why, {QUALITY} AS quality FROM takes) q)"


def raw_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Take rows without their phrase. The number is taken before any join."""
    return _raw_takes(table(spark, sf_dir, "lineitem"), hot_orders(spark, sf_dir))


def _raw_takes(lineitem: DataFrame, hot: Hot, *carried: str) -> DataFrame:
    lines = number_rows(
        lineitem,
        ["l_orderkey"],
        [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")],
        [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 65536)],
        "_rn",
        hot,
    ).withColumn("take_id", (F.col("_rn") - 1).cast("int"))
    return lines.selectExpr(*_split(TAKE_COLUMNS), *carried)


def bare_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        *_split(PHRASE_COLUMNS), "sha2(CAST(o_orderkey % 997 AS STRING), 256) AS text_hash"
    )


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = number_rows(
        bare_phrases(spark, sf_dir),
        ["project_id", "block_id"],
        [F.col("phrase_id")],
        [F.floor(F.col("phrase_id") / 65536)],
        "_rn",
        hot_blocks(spark, sf_dir),
    )
    return numbered.withColumn("phrase_idx", (F.col("_rn") - 1).cast("int")).drop("_rn")


def takes(spark: SparkSession, sf_dir: str, phrases: DataFrame | None = None) -> DataFrame:
    """Take rows with project, block and class flags of their phrase, and what else ``phrases`` brings."""
    return raw_takes(spark, sf_dir).join(bare_phrases(spark, sf_dir) if phrases is None else phrases, "phrase_id")


def takes_in_place(
    spark: SparkSession, sf_dir: str, phrases: DataFrame, exp2: Callable[[Column], Column], log2: Callable[[Column], Column]
) -> list[DataFrame]:
    """What ``takes`` gives, with ``exp2`` in the place of Spark's ``pow`` in the pitch, and ``octaves``, the ``log2`` of pitch over anchor.

    Takes are not shuffled behind their numbering: those of hot phrases lie in chunks, a part of their own that
    the few listed phrases come to; all others lie by phrase. Rows lose their place where they go
    through Python, so the pitch is taken before.
    """
    lineitem = table(spark, sf_dir, "lineitem").withColumn("_hz", F.lit(235.0) * exp2(F.expr("(l_tax-4e-2)*625e-1/12e0")))
    listed, parts = hot_orders(spark, sf_dir), []
    for lines, heat in parts_by_heat(lineitem.withColumn("octaves", log2(F.col("_hz") / F.lit(235.0))), ["l_orderkey"], listed):
        few = F.broadcast(phrases.where(F.col("phrase_id").isin([k[0] for k in listed]))) if listed and heat is None else phrases
        numbered = _raw_takes(lines, heat, "_hz", "octaves").withColumn("median_hz", F.col("_hz")).drop("_hz")
        parts.append(numbered.join(few, "phrase_id"))
    return parts


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        bare_phrases(spark, sf_dir)
        .where("phrase_id % 4 = 0")
        .selectExpr("project_id", "block_id", "phrase_id", "CAST(phrase_id % 3 AS INT) AS take_id")
    )


def _split(columns: str) -> list[str]:
    """Top-level comma split of a select list."""
    out, depth, cur = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


def with_sql(*parts: str, tail: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + tail
