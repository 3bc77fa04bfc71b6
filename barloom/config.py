"""Parameters with their defaults; every operator takes what it needs from here."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import TypeVar

_T = TypeVar("_T")


@dataclass(frozen=True)
class Horizon:
    """Context length, forecast length and samples of a forecast window."""

    lookback: int = 500
    pred_len: int = 12
    samples: int = 5


#: For the short histories of the sample tables.
SHORT = Horizon(lookback=48, pred_len=6, samples=5)


@dataclass(frozen=True)
class Trading:
    q_long: float = 0.9
    q_short: float = 0.1
    tp_q: float = 0.8
    sl_q: float = 0.2
    commission: float = 0.0
    consensus: float = 0.8
    exit_consensus: float = 0.6


# Bars a year that the different annualisations assume.
PERIODS_STRATEGY = 52 * 252
PERIODS_QUARTER = 6 * 24 * 252
PERIODS_TRADE = 252
PERIODS_WINDOW = 104


def merged(*layers: Mapping) -> dict:
    """Nested maps merged, the last wins; where one side is no map, it is replaced whole."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            both = isinstance(out.get(key), Mapping) and isinstance(value, Mapping)
            out[key] = merged(out[key], value) if both else value
    return out


def load_config(*paths: str) -> dict:
    """YAML or JSON files, at any path or URI that pyarrow's file systems open, merged in order.

    A file may also be given as ``name=path``; its map is then put under that name.
    An empty file is an empty map; one that isn't a map is an error.
    """
    from pyarrow import fs

    layers = []
    for path in paths:
        name, _, place = path.rpartition("=")
        system, inner = fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)
        with system.open_input_stream(inner) as stream:
            text = stream.read().decode()
        found = _parsed(text)
        if found is None:
            found = {}
        if not isinstance(found, Mapping):
            raise ValueError(f"{place} holds no map")
        layers.append({name: found} if name else found)
    return merged(*layers)


def _parsed(text: str) -> object:
    from importlib.util import find_spec

    if find_spec("yaml"):
        import yaml

        return yaml.safe_load(text)
    import json

    return json.loads(text) if text.strip() else None


def configured(default: _T, values: Mapping) -> _T:
    """A parameter object with the fields that ``values`` names; unknown names are an error."""
    known = {f.name for f in fields(default)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown parameters: {unknown}")
    return replace(default, **values)
