"""All registered queries."""

from __future__ import annotations

import importlib

_SUBJECTS = ("ids", "rollout", "links", "log", "history", "archive")


def registered() -> dict:
    """Name to (query, SQL counterpart or None)."""
    found = {}
    for subject in _SUBJECTS:
        found.update(importlib.import_module(f"fleetledger.plans.queries_{subject}").QUERIES)
    return found
