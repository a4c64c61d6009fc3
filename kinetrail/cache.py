"""Results and jump tables kept as Parquet, and logging."""

from __future__ import annotations

import functools
import hashlib
import inspect
import json
import logging
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import pbc

SALT = "kinetrail"
_state: dict = {"folder": None, "load": True}


def setlevel(level: int | str, file: str | None = None) -> logging.Logger:
    logger = logging.getLogger("kinetrail")
    logger.setLevel(level)
    if file:
        logger.addHandler(logging.FileHandler(file))
    return logger


def version(number: int | str, calls: tuple = ()) -> Callable:
    """Pin a function's checksum to a version number, and to the functions it calls."""

    def mark(f: Callable) -> Callable:
        f.__checksum__ = lambda: checksum(str(number), f.__name__, *calls)
        return f

    return mark


def strip_comments(source: str) -> str:
    """Source text without comment lines and without a trailing comment after two spaces."""
    return "\n".join(line for line in (re.sub(r"(^|\s\s)#.*$", "", x).rstrip() for x in source.splitlines()) if line)


def checksum(*args: object, salt: str = SALT) -> str:
    """A digest of values by content: frames by their plan, functions by source, arrays by bytes, mappings by name."""
    h = hashlib.sha1(salt.encode())

    def add(x: object) -> None:
        if hasattr(x, "__checksum__"):
            h.update(str(x.__checksum__()).encode())
        elif isinstance(x, DataFrame):
            h.update(str(x.semanticHash()).encode())
        elif isinstance(x, bytes):
            h.update(x)
        elif isinstance(x, str):
            h.update(x.encode())
        elif isinstance(x, functools.partial):
            add(x.func)
            add(list(x.args))
            add(dict(x.keywords))
        elif inspect.isfunction(x):
            h.update(strip_comments(inspect.getsource(x)).encode())
            for cell in x.__closure__ or ():
                add(cell.cell_contents)
        elif isinstance(x, dict):
            for k in sorted(x, key=str):
                add(f"{k}=")
                add(x[k])
        elif isinstance(x, list | tuple):
            h.update(f"[{len(x)}]".encode())
            for y in x:
                add(y)
        elif hasattr(x, "tobytes"):
            h.update(x.tobytes())
        else:
            h.update(str(x).encode())

    for a in args:
        add(a)
    return h.hexdigest()


def enable(folder: str, load: bool = True) -> None:
    _state.update(folder=folder.rstrip("/"), load=load)


def disable() -> None:
    _state.update(folder=None)


@contextmanager
def disabled() -> Iterator[None]:
    """No caching inside; the state before is restored."""
    held = dict(_state)
    disable()
    try:
        yield
    finally:
        _state.update(held)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached_result(number: int | str = 1) -> Callable:
    """Keep a function's DataFrame result under a digest of its version and its arguments by name.

    The decorated function takes ``description`` (part of the file's name) and ``autoload``.
    """

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(f)

        @functools.wraps(f)
        def call(*args, description: str = "", autoload: bool = True, **kwargs) -> DataFrame:
            if _state["folder"] is None:
                return f(*args, **kwargs)
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            spark = next(x.sparkSession for x in bound.arguments.values() if isinstance(x, DataFrame))
            name = "_".join(x for x in (f.__name__, re.sub(r"\W+", "-", description)) if x)
            path = f"{_state['folder']}/{name}_{checksum(f.__name__, str(number), dict(bound.arguments))}"
            if not (autoload and _state["load"] and _exists(spark, f"{path}/_SUCCESS")):
                f(*args, **kwargs).write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)

        return call

    return wrap


def save_jumps(positions: DataFrame, path: str, fingerprint: str) -> DataFrame:
    pbc.jumps(positions).withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite").parquet(path)
    return load_jumps(positions.sparkSession, path, fingerprint)


def load_jumps(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """A stored jump table; ValueError if it belongs to another trajectory."""
    held = spark.read.parquet(path)
    if not held.where(F.col("fingerprint") != fingerprint).isEmpty():
        raise ValueError("the jump table belongs to another trajectory")
    return held.drop("fingerprint")


def describe(parameters: dict) -> str:
    return json.dumps(parameters, sort_keys=True, default=str)
