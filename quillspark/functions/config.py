"""Layered configuration (F53). A driver-side value, so plain dictionaries."""

from __future__ import annotations

#: Lists under these keys are concatenated without repeats; all other values are replaced.
JOINED = ("plugin", "instructions")


def merged(*layers: dict) -> dict:
    """Deep merge in which later layers win."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            old = out.get(k)
            if isinstance(old, dict) and isinstance(v, dict):
                out[k] = merged(old, v)
            elif k in JOINED and isinstance(old, list) and isinstance(v, list):
                out[k] = list(dict.fromkeys([*old, *v]))
            else:
                out[k] = v
    return out
