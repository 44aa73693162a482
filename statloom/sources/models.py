"""Models as JSON: values that JSON lacks are tagged, arrays are kept as lists with their shape implied."""

from __future__ import annotations

import json
import math
from dataclasses import fields, is_dataclass
from typing import Any

import numpy as np

FORMAT = "statloom-model"
_KINDS: dict[str, type] = {}


def saveable(cls: type) -> type:
    """Class decorator: instances of this dataclass can be saved and loaded."""
    _KINDS[cls.__name__] = cls
    cls.to_json = lambda self: save(self)
    cls.from_json = classmethod(lambda c, text: load(text))
    return cls


def to_plain(v: Any) -> Any:
    """JSON-ready form of a value; NaN, infinities, arrays, sets and saveable objects are tagged."""
    if isinstance(v, (bool, str, int)) or v is None:
        return v
    if isinstance(v, np.generic):
        return to_plain(v.item())
    if isinstance(v, float):
        return v if math.isfinite(v) else {"$": "number", "v": "nan" if math.isnan(v) else "inf" if v > 0 else "-inf"}
    if isinstance(v, np.ndarray):
        return {"$": "array", "v": to_plain(v.tolist())}
    if isinstance(v, dict):
        return {"$": "map", "v": [[to_plain(k), to_plain(x)] for k, x in v.items()]}
    if isinstance(v, tuple):
        return {"$": "tuple", "v": [to_plain(x) for x in v]}
    if isinstance(v, list):
        return [to_plain(x) for x in v]
    if is_dataclass(v) and type(v).__name__ in _KINDS:
        return {"$": type(v).__name__, "v": {f.name: to_plain(getattr(v, f.name)) for f in fields(v)}}
    raise TypeError(f"{type(v).__name__} can't be saved")


def from_plain(v: Any) -> Any:
    if isinstance(v, list):
        return [from_plain(x) for x in v]
    if not isinstance(v, dict):
        return v
    kind, body = v["$"], v["v"]
    if kind == "number":
        return float(body)
    if kind == "array":
        return np.array(from_plain(body))
    if kind == "map":
        return {from_plain(k): from_plain(x) for k, x in body}
    if kind == "tuple":
        return tuple(from_plain(x) for x in body)
    if kind not in _KINDS:
        raise ValueError(f"unknown kind of model: {kind}")
    return _KINDS[kind](**{k: from_plain(x) for k, x in body.items()})


def save(model: Any) -> str:
    return json.dumps({"format": FORMAT, "version": 1, "model": to_plain(model)}, allow_nan=False)


def load(text: str) -> Any:
    data = json.loads(text)
    if data.get("format") != FORMAT:
        raise ValueError("not a saved model")
    return from_plain(data["model"])
