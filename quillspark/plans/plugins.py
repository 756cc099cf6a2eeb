"""User functions, plugin modules and hooks."""

from __future__ import annotations

import importlib.util
import inspect
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tool:
    """A vectorised function over pandas Series, its result type and its argument types."""

    name: str
    returns: str
    run: Callable[..., pd.Series]
    args: tuple[str, ...]


def tool(returns: str, *args: str) -> Callable[[Callable], Tool]:
    """Decorator for plugin modules."""
    return lambda fn: Tool(fn.__name__, returns, fn, args)


def register(spark: SparkSession, t: Tool) -> None:
    """Makes a tool callable from SQL (X01); a tool of the same name is replaced."""
    if not t.name.isidentifier():
        raise ValueError(f"not a name: {t.name}")
    n, run = len(t.args), t.run

    if n == 1:
        def body(a: pd.Series) -> pd.Series:
            return run(a)
    elif n == 2:
        def body(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)
    elif n == 3:
        def body(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return run(a, b, c)
    else:
        raise ValueError("a tool takes one to three columns")
    body.__annotations__ = dict.fromkeys(inspect.signature(body).parameters, pd.Series) | {"return": pd.Series}
    spark.udf.register(t.name, F.pandas_udf(body, t.returns))


def discover(spark: SparkSession, root: str) -> list[str]:
    """Registers the tools of every module in ``tool`` and ``tools`` below a local folder of the
    driver, named file_export (X02)."""
    names = []
    for path in sorted(p for sub in ("tool", "tools") for p in Path(root, sub).glob("*.py")):
        spec = importlib.util.spec_from_file_location(f"quillspark_plugin_{path.stem}", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        for export, t in vars(module).items():
            if isinstance(t, Tool):
                name = f"{path.stem}_{export}"
                register(spark, Tool(name, t.returns, t.run, t.args))
                names.append(name)
    return names


def with_hooks(query: Callable, before: list[Callable] = (), after: list[Callable] = ()) -> Callable[[SparkSession, str], DataFrame]:
    """A query with functions run on its path before, and on its result after."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for f in before:
            sf_dir = f(sf_dir) or sf_dir
        out = query(spark, sf_dir)
        for f in after:
            out = f(out)
        return out

    return run
