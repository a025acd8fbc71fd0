"""Registered queries over the test tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

import importlib
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MODULES = ("curation", "clip_metrics", "detection", "waveforms", "augmentation", "files", "models", "streams")


def registered() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in _MODULES:
        try:
            module = importlib.import_module(f"workloads.{name}")
        except ModuleNotFoundError as exc:
            if exc.name != f"workloads.{name}":
                raise
            continue
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
