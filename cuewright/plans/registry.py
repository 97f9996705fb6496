"""All registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "take_queries", "bank_queries", "ranking_queries", "text_queries", "signal_queries", "experiment_queries", "session_queries",
    "extra_queries",
)


def catalog() -> dict:
    out: dict = {}
    for name in MODULES:
        for key, entry in import_module(f"{__package__}.{name}").QUERIES.items():
            if key in out:
                raise KeyError(f"query registered twice: {key}")
            out[key] = entry
    return out
