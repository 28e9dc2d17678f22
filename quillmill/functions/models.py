"""Slots for models: a model's batch function becomes a column function, in the place of the rules that stand in for it.

make is called once a worker (or each time it is new there) and gives the model, a function from a list of inputs to a list
of as many results. It must be picklable: a module's function, or one that closes over small things only.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

_loaded: dict[str, Callable] = {}


def slot(name: str, make: Callable[[], Callable[[list], list]], kind: str) -> Callable[[Column | str], Column]:
    """A column function of a model; kind is the result's type as DDL. Nulls are given to the model as empty texts."""

    module = __name__

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        loaded = importlib.import_module(module)._loaded  # the worker's own, kept between tasks
        if name not in loaded:
            loaded[name] = make()
        given = ["" if v is None else v for v in values.tolist()]
        return pd.Series(loaded[name](given) if given else [], dtype=object if kind not in ("double", "float", "int", "long", "boolean") else None)

    return lambda c: run(_col(c))


def encoder(name: str, make: Callable[[], Callable[[list], list]]) -> Callable[[Column | str], Column]:
    """A text encoder: array<float> of each text."""
    return slot(name, make, "array<float>")


def classifier(name: str, make: Callable[[], Callable[[list], list]]) -> Callable[[Column | str], Column]:
    """A classifier of sentences: a label of each."""
    return slot(name, make, "string")


def tagger(name: str, make: Callable[[], Callable[[list], list]]) -> Callable[[Column | str], Column]:
    """A tagger of words: an array of tags of each text."""
    return slot(name, make, "array<string>")
