"""Functions that stand in for models in registered queries. Workers import this module, so it makes no columns."""

from __future__ import annotations


def lengths():
    return lambda texts: [len(t) for t in texts]


def shape():
    return lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts]


def kinds():
    return lambda texts: ["long" if len(t) > 500 else "short" for t in texts]


def tags():
    return lambda texts: [["B-objectives" if k == 0 else "I-objectives" for k, _ in enumerate(t.split("\n"))] for t in texts]
