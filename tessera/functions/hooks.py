"""Pluggable external functions with deterministic offline defaults (UDF01-03, UDF05-06, CFG01, SRC19, RAG02)."""

from __future__ import annotations

import inspect
import typing
from collections.abc import Callable

import pandas as pd
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark types of Python annotations.
TYPES = {int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), str: T.StringType(), dict: T.MapType(T.StringType(), T.StringType()), list: T.ArrayType(T.StringType())}


def tool_schema(f: Callable) -> dict:
    """UDF01: name, description, parameters (with types) and required ones of a function."""
    hints, parameters = typing.get_type_hints(f), inspect.signature(f).parameters
    types = {n: TYPES[typing.get_origin(h) or h].simpleString() if (h := hints.get(n, str)) in TYPES or typing.get_origin(h) in TYPES else "string" for n in parameters}
    return {"name": f.__name__, "description": inspect.getdoc(f) or "", "parameters": types, "required": [n for n, p in parameters.items() if p.default is p.empty]}


def register_tool(spark: SparkSession, f: Callable) -> dict:
    """UDF01: makes a function callable from SQL by its name, in Arrow batches; the result type follows from its annotation."""
    result = typing.get_type_hints(f).get("return", str)
    spark.udf.register(f.__name__, F.udf(f, TYPES.get(typing.get_origin(result) or result, T.StringType()), useArrow=True))
    return tool_schema(f)


def call_tool(f: Callable, arguments: dict):
    """UDF01: checks names and types, then calls."""
    schema, hints = tool_schema(f), typing.get_type_hints(f)
    if unknown := set(arguments) - set(schema["parameters"]):
        raise ValueError(f"unknown arguments: {sorted(unknown)}")
    if absent := set(schema["required"]) - set(arguments):
        raise ValueError(f"missing arguments: {sorted(absent)}")
    for n, v in arguments.items():
        kind = typing.get_origin(hints.get(n)) or hints.get(n)
        if kind in TYPES and not isinstance(v, (int, float) if kind is float else kind):
            raise TypeError(f"{n} must be {kind.__name__}")
    return f(**arguments)


def per_row(rows: DataFrame, text: str, f: Callable[[str], str], name: str = "result") -> DataFrame:
    """UDF02, UDF03: the rows with a function's result and, where it failed, its error; other rows aren't affected."""

    def one(x):
        try:
            return f(x), None
        except Exception as e:  # noqa: BLE001  the error is the row's result
            return None, f"{type(e).__name__}: {e}"

    @F.pandas_udf(f"{name} string, error string")
    def both(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in texts], columns=[name, "error"])

    return rows.withColumn("_r", both(F.col(text))).select(*rows.columns, f"_r.{name}", "_r.error")


def first_long_enough(*texts, least: int = 100):
    """SRC19: the first of several conversions that has at least so many characters."""
    return F.coalesce(*(F.when(F.length(t) >= least, t) for t in texts))


def summarize(text: str, sentences: int = 2) -> str:
    """UDF02's offline default: the first sentences."""
    return ". ".join((text or "").replace("\n", " ").split(". ")[:sentences]).strip()


def embed(text, width: int = 64):
    """RAG02's offline default: hashed word counts, of unit length, as a column. Without words, all its numbers are null."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int"))

    @F.arrow_udf("array<float>")
    def counted(lists: pa.Array) -> pa.Array:
        n = len(lists)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(n), sizes) * width + lists.flatten().to_numpy(zero_copy_only=False)
        counts = np.bincount(at, minlength=n * width).reshape(n, width).astype(np.float64)
        length = np.repeat(np.sqrt((counts * counts).sum(axis=1)), width)
        shares = np.divide(counts.ravel(), length, out=np.zeros(n * width), where=length > 0).astype(np.float32)
        return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(shares, mask=length == 0))

    return counted(places)


#: Parsers by name: each maps rows (path, text) to rows (path, markdown, structured_json).
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_parser(name: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    """UDF05: makes a parser known."""
    PARSERS[name] = parser


def parse(rows: DataFrame, name: str = "plain") -> DataFrame:
    """UDF05: path, markdown, structured_json by the parser of a name."""
    if name not in PARSERS:
        raise ValueError(f"unknown parser: {name}; known: {sorted(PARSERS)}")
    return PARSERS[name](rows).select("path", "markdown", "structured_json")


def _plain(rows: DataFrame) -> DataFrame:
    heads = F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6}[ \t]+(.+)$"), F.lit(1))
    return rows.select("path", F.col("text").alias("markdown"), F.to_json(F.struct(heads.alias("headings"))).alias("structured_json"))


register_parser("plain", _plain)


def run_tools(rows: DataFrame, reply: str, tools: dict[str, Callable]) -> DataFrame:
    """UDF06: rows with content, the result of the tool that a reply {"tool": name, "arguments": {...}} names, as text.

    tools: functions from the arguments' JSON, as a column, to a column. A name that no tool has gives an error as content; a reply
    without a tool gives null.
    """
    name, arguments = F.get_json_object(reply, "$.tool"), F.get_json_object(reply, "$.arguments")
    content = F.when(name.isNotNull(), F.concat(F.lit("Error: Function "), name, F.lit(" is not available.")))
    for tool, f in tools.items():
        content = F.when(name == tool, f(arguments).cast("string")).otherwise(content)
    return rows.withColumn("content", content)


def template(key, variable, names: list[str]):
    """CFG01: the template a key names, else the one the environment names, else the first, as a column; an unknown name fails."""
    chosen = F.coalesce(key, variable, F.lit(names[0]))
    return F.when(chosen.isin(*names), chosen).otherwise(F.raise_error(F.concat(F.lit("unknown template: "), chosen)).cast("string"))
