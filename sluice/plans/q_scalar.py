"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import scalar as S
from sluice.plans.registry import op, sql_op
from sluice.sources.tables import table


def _fn(name: str, tbl: str, key: str, where: str, oracle: str, make) -> None:
    @op(name, f"SELECT {key}, {oracle} AS v FROM {tbl} WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, tbl).where(where).select(key, make().alias("v"))


_fn("str_01_concat_skips_nulls", "orders", "o_orderkey", "TRUE", "concat('a', nullif(o_orderstatus, 'F'), '-', o_orderpriority)", lambda: S.concat_skip_nulls(F.lit("a"), F.expr("nullif(o_orderstatus, 'F')"), F.lit("-"), "o_orderpriority"))
_fn("str_02_concat_operator", "orders", "o_orderkey", "TRUE", "'a' || nullif(o_orderstatus, 'F')", lambda: F.concat(F.lit("a"), F.expr("nullif(o_orderstatus, 'F')")))
_fn("str_03_substring", "customer", "c_custkey", "TRUE", "substring(c_name, greatest(c_custkey % 12 - 3, 1), 5)", lambda: S.substring("c_name", (F.col("c_custkey") % 12 - 3).cast("int"), F.lit(5)))
_fn("str_04_upper", "part", "p_partkey", "TRUE", "upper(p_name)", lambda: F.upper("p_name"))
_fn("str_05_lower", "part", "p_partkey", "TRUE", "lower(p_type)", lambda: F.lower("p_type"))
_fn("str_06_trim", "part", "p_partkey", "TRUE", "regexp_replace(chr(9) || ' ' || p_name || '  ', '^\\s+|\\s+$', '', 'g')", lambda: S.trim_space(F.concat(F.lit("\t "), "p_name", F.lit("  "))))
_fn("str_07_length", "orders", "o_orderkey", "TRUE", "coalesce(length(nullif(o_orderpriority, '5-LOW')), 0)", lambda: S.length0(F.expr("nullif(o_orderpriority, '5-LOW')")))
_fn("str_08_replace", "part", "p_partkey", "TRUE", "replace(p_type, 'A', 'xx')", lambda: F.replace("p_type", F.lit("A"), F.lit("xx")))
_fn("str_09_charindex", "part", "p_partkey", "TRUE", "CAST(coalesce(instr(lower(p_type), 'an'), 0) AS BIGINT)", lambda: S.charindex(F.lit("AN"), "p_type"))
_fn("mth_01_abs", "supplier", "s_suppkey", "TRUE", "abs(s_acctbal - 5000)", lambda: F.abs(F.col("s_acctbal") - 5000))
_fn("mth_02_round_even", "lineitem", "l_orderkey", "TRUE", "round_even(l_quantity / 2, 0)", lambda: S.round_even(F.col("l_quantity") / 2))
_fn("mth_03_ceiling", "supplier", "s_suppkey", "TRUE", "CAST(ceil(s_acctbal / 7) AS DOUBLE)", lambda: S.ceiling(F.col("s_acctbal") / 7))
_fn("mth_04_floor", "supplier", "s_suppkey", "TRUE", "CAST(floor(s_acctbal / 7) AS DOUBLE)", lambda: S.floor(F.col("s_acctbal") / 7))
_fn("mth_05_power", "part", "p_partkey", "TRUE", "power(p_size, 2)", lambda: F.pow("p_size", F.lit(2)))
_fn("mth_06_remainder", "supplier", "s_suppkey", "TRUE", "round((s_acctbal - 4000) % 3.5::DOUBLE, 6) + 0.0::DOUBLE", lambda: F.round((F.col("s_acctbal") - 4000) % F.lit(3.5), 6) + F.lit(0.0))
_fn("cnd_01_coalesce", "orders", "o_orderkey", "TRUE", "coalesce(nullif(o_orderstatus, 'F'), nullif(o_orderpriority, '5-LOW'), 'none')", lambda: F.expr("coalesce(nullif(o_orderstatus, 'F'), nullif(o_orderpriority, '5-LOW'), 'none')"))
_fn("cnd_02_nullif", "orders", "o_orderkey", "TRUE", "nullif(o_orderstatus, 'O')", lambda: F.nullif("o_orderstatus", F.lit("O")))
_fn("cnd_03_iif", "orders", "o_orderkey", "TRUE", "CASE WHEN nullif(o_orderstatus, 'F') = 'O' THEN 'open' ELSE 'other' END", lambda: S.iif(F.expr("nullif(o_orderstatus, 'F')") == "O", "open_", "x") if False else S.iif(F.expr("nullif(o_orderstatus, 'F')") == "O", F.lit("open"), F.lit("other")))
_fn("dte_02_dateadd", "orders", "o_orderkey", "TRUE", "o_orderdate + to_months(CAST(o_orderkey % 14 AS INTEGER)) + to_days(3) - to_hours(5)", lambda: S.dateadd("H", F.lit(-5), S.dateadd("DAY", F.lit(3), S.dateadd("MONTH", (F.col("o_orderkey") % 14).cast("int"), "o_orderdate"))))
_fn("dte_03_datediff", "events", "event_id", "TRUE", "date_sub('hour', ts, TIMESTAMP '2024-03-01 05:59:00') * 1000000 + date_sub('day', ts, TIMESTAMP '2024-03-01 05:59:00')", lambda: S.datediff("HOUR", "ts", F.lit("2024-03-01 05:59:00").cast("timestamp_ntz")) * 1000000 + S.datediff("DAY", "ts", F.lit("2024-03-01 05:59:00").cast("timestamp_ntz")))


@op("dte_01_now", "SELECT now() <= now() + INTERVAL 1 SECOND AS is_now, CAST(now() AT TIME ZONE 'UTC' AS DATE) AS today")
def now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOW() against the driver's clock, and the date in UTC."""
    import time

    return spark.range(1).select((F.abs(F.unix_timestamp(F.current_timestamp()) - F.lit(int(time.time()))) < 120).alias("is_now"), F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())).alias("today"))


@op("sys_01_session_scalars", "SELECT 'default' AS db, 'default' AS schema_name, TRUE AS has_version, TRUE AS has_user, 1 AS one, 'UTC' AS setting")
def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("sluice.setting", "UTC")  # set_config, and current_setting below
    return spark.sql("SELECT current_database() AS db, current_schema() AS schema_name, length(version()) > 0 AS has_version, length(current_user()) > 0 AS has_user, 1 AS one").withColumn("setting", F.lit(spark.conf.get("sluice.setting")))


sql_op("cnd_04_user_function_call", "SELECT o_orderkey, o_totalprice * 0.19 AS tax FROM orders",
       "SELECT o_orderkey, o_totalprice * 0.19::DOUBLE AS tax FROM orders")
