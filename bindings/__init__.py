"""Bindings of the operators to the test tables, each with its SQL twin where one exists."""

from __future__ import annotations

from bindings.registry import ORACLES, QUERIES  # noqa: F401


def load_all() -> None:
    from importlib import import_module

    for area in AREAS:
        import_module(f"bindings.{area}")


AREAS: list[str] = [
    "sources", "selecting", "preparing", "profiling", "advising", "knowledge", "training", "measuring", "imaging", "logging",
]
