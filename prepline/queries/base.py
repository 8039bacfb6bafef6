"""Frames that queries start from, as expressions that Spark and DuckDB both read, and helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepline.functions.sqltext import name
from prepline.queries.registry import Registry
from prepline.sources import table

KEYS = ["l_orderkey", "l_linenumber"]

#: name: (table, {column: expression}); nulls are made here, as the star tables have none.
FRAMES: dict[str, tuple[str, dict[str, str]]] = {
    "line": (
        "lineitem",
        {
            "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey", "qty": "case when l_orderkey % 10 = 0 then null else l_quantity end", "price": "l_extendedprice",
            "disc": "l_discount", "tax": "case when l_linenumber = 3 then null else l_tax end", "flag": "case when l_orderkey % 7 = 0 then null else l_returnflag end", "status": "l_linestatus", "ship": "l_shipdate",
            "target": "case when l_returnflag = 'R' then 1 else 0 end",
        },
    ),
    "cust": ("customer", {"c_custkey": "c_custkey", "c_name": "c_name", "c_nationkey": "c_nationkey", "bal": "case when c_custkey % 9 = 0 then null else c_acctbal end", "seg": "case when c_custkey % 11 = 0 then null else c_mktsegment end"}),
    "parts": ("part", {"p_partkey": "p_partkey", "p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type", "p_size": "p_size", "p_retailprice": "p_retailprice"}),
    "ord": ("orders", {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus", "o_totalprice": "o_totalprice", "o_orderdate": "o_orderdate", "o_orderpriority": "o_orderpriority"}),
    "houses": ("house_prices", {c: c for c in ("id", "ms_sub_class", "ms_zoning", "lot_frontage", "year_built", "heating", "central_air", "price_over_200k")}),
    "pairs": ("binary_pairs", {"pair_id": "pair_id", "actual": "actual", "predicted": "case when isnan(predicted) then null else predicted end"}),
    "ads": ("advertising", {c: c for c in ("rec_id", "id", "load_id", "area_id", "daily_time_spent_on_site", "age", "age_band", "area_income", "daily_internet_usage", "city", "country", "one_hot_test", "clicked_on_ad", "ad_ts")}),
    "ev": ("events", {"event_id": "event_id", "ts": "ts", "user_id": "user_id", "event_type": "event_type", "value": "value", "props": "props"}),
    "emb": ("embeddings", {"vec_id": "vec_id", "embedding": "embedding", "label": "label"}),
    "docs": ("documents", {"doc_id": "doc_id", "text": "text", "lang": "lang", "source": "source", "n_chars": "n_chars", "page_no": "page_no", "issue_date": "issue_date"}),
}


def frame(spark: SparkSession, d: str, which: str) -> DataFrame:
    t, cols = FRAMES[which]
    return table(spark, d, t).selectExpr(*[f"{e} as {a}" for a, e in cols.items()])


def cte(which: str) -> str:
    """``t as (...)``: the same frame in SQL."""
    t, cols = FRAMES[which]
    return f"t as (select {', '.join(f'{e} as {a}' for a, e in cols.items())} from {t})"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums depend on their order in the last digits; -0.0 is 0.0."""
    return df.select(*[(F.round(F.col(name(f.name)).cast("double"), digits) + 0.0).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(name(f.name)) for f in df.schema.fields])


def names(spark: SparkSession, found: Sequence[str]) -> DataFrame:
    """Columns that were found, as a table."""
    return spark.createDataFrame([(c,) for c in found], "column_name string")


def names_sql(found: Sequence[str]) -> str:
    return f"select unnest([{', '.join(repr(c) for c in found)}]::varchar[]) column_name"


class Queries(Registry):
    """A registry of queries that are one function of one frame."""

    def on(self, which: str, key: str, f: Callable[[DataFrame], DataFrame | Sequence[str]], sql: str | None = None, digits: int | None = 6) -> None:
        """Adds query ``key``; ``sql`` may use ``t``. A function that gives a list gives names of columns."""

        def run(spark: SparkSession, d: str) -> DataFrame:
            found = f(frame(spark, d, which))
            out = found if isinstance(found, DataFrame) else names(spark, found)
            return out if digits is None else rounded(out, digits)

        run.__name__ = key
        run.__doc__ = f"{key} on {FRAMES[which][0]}."
        self.query(None if sql is None else f"with {cte(which)}{', ' if sql.startswith('+') else ' '}{sql.removeprefix('+')}")(run)
