"""Imports every module that registers queries."""

from __future__ import annotations

from skylot.plans import audits, corpus, demand, evaluation, extraction, facts, flights, fronts, mined, quality, records, space, streams, truth  # noqa: F401

FLAGSHIP = "window_rank"
