"""Calls that don't fit what they call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..functions import calls as C
from ..model import CALLABLE_TYPES

_INT = IntegerType()
_PARAMS = StructType([StructField("least", _INT), StructField("most", _INT), StructField("variadic", BooleanType())])
_CALL = StructType([StructField("args", _INT), StructField("line", _INT)])


@F.pandas_udf(_PARAMS)
def _params(text: pd.Series, extension: pd.Series) -> pd.DataFrame:
    own = [C.params(t or "", e or "") for t, e in zip(text, extension)]
    return pd.DataFrame({"least": [p and p.least for p in own], "most": [p and p.most for p in own], "variadic": [p and p.variadic for p in own]}).astype({"least": "Int32", "most": "Int32", "variadic": "boolean"})


@F.pandas_udf(_CALL)
def _first_call(text: pd.Series, name: pd.Series, extension: pd.Series) -> pd.DataFrame:
    own = [C.first_call(t or "", n, e or "") for t, n, e in zip(text, name, extension)]
    return pd.DataFrame({"args": [c and c[0] for c in own], "line": [c and c[1] for c in own]}).astype("Int32")


@F.pandas_udf(_INT)
def _param_count(text: pd.Series) -> pd.Series:
    return text.map(lambda t: C.param_count(t or ""))


@F.pandas_udf(_INT)
def _call_arguments(text: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([C.call_arguments(t or "", n) for t, n in zip(text, name)], dtype="Int32")


def _extension(path: str):
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def callables(entities: DataFrame) -> DataFrame:
    """Functions with the arguments that they take, computed once each and not once a call."""
    own = entities.filter(F.col("entity_type").isin(*CALLABLE_TYPES)).withColumn("p", _params("content", _extension("file_path")))
    return own.select("id", "name", "file_path", "p.least", "p.most", "p.variadic").filter("least IS NOT NULL")


def contract_violations(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """By text alone: first calls whose arguments aren't as many as the first line's parameters; functions without any are passed over."""
    callee = entities.filter(F.col("entity_type").isin(*CALLABLE_TYPES)).select(F.col("id").alias("dst"), F.col("name").alias("entity_name"), "file_path", _param_count("content").alias("expected_params")).filter("expected_params > 0")
    caller = entities.select(F.col("id").alias("src"), F.col("name").alias("caller_name"), F.col("file_path").alias("caller_file"), "content")
    met = edges.filter("ref_type = 'calls'").select("src", "dst").distinct().join(callee, "dst").join(caller, "src")
    counted = met.withColumn("actual_args", _call_arguments("content", "entity_name"))
    return counted.filter("actual_args <> expected_params").select("entity_name", "file_path", "expected_params", "caller_name", "caller_file", "actual_args")


def arity_mismatches(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """First calls with too few or too many arguments; variadic functions fit any."""
    callee = callables(entities).filter("NOT variadic").select(F.col("id").alias("dst"), F.col("name").alias("callee_name"), "least", "most")
    caller = entities.select(F.col("id").alias("src"), "file_path", "content", "start_line")
    met = edges.filter("ref_type = 'calls'").select("src", "dst").distinct().join(callee, "dst").join(caller, "src")
    seen = met.withColumn("c", _first_call("content", "callee_name", _extension("file_path")))
    wrong = seen.filter("c.args IS NOT NULL AND (c.args < least OR c.args > most)")
    return wrong.select(F.col("src").alias("caller_entity"), F.col("dst").alias("callee_entity"), F.col("least").alias("expected_min"), F.col("most").alias("expected_max"), F.col("c.args").alias("actual_args"), "file_path", (F.col("start_line") + F.col("c.line")).alias("line"))


def broken_callers(before: DataFrame, after: DataFrame, edges: DataFrame) -> DataFrame:
    """Mismatches of calls to functions of unchanged id whose parameters changed."""
    b = callables(before).select("id", F.col("least").alias("b_least"), F.col("most").alias("b_most"))
    changed = callables(after).join(b, "id").filter("least <> b_least OR most <> b_most").select(F.col("id").alias("dst"))
    return arity_mismatches(edges.join(changed, "dst", "left_semi"), after)
