"""Layered settings: defaults, then files, then ``key=value`` overrides.

Unknown keys raise, so a misspelt setting never passes silently.
"""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = {
    "seed": 0,
    "graph": {"granularity": "ip", "anchor_bin_s": 1, "window_s": {"short": 1, "mid": 30, "long": 300}, "cap": 32, "strata": 4, "sampler": "recency_stratified", "memory_s": 600},
    "features": {"quantiles": 1000, "clip": 5.0, "te1": True, "te2": True, "temporal": True, "topk": {"protocol": 8, "l7_proto": 16, "dst_port": 32}},
    "model": {"dim": 64, "aggregate": "trimmed", "trim_beta": 0.2, "norm": "layer", "margin": 0.2, "tau_start": 0.5, "tau_final": 0.1, "tau_min": 0.05, "clamp": 15.0},
    "decide": {"theta_unknown": None, "theta_defer": None, "unknown_quantile": 0.05, "defer_quantile": 0.02},
    "data": {"dataset": "cicids2018", "target_rows": 4_000_000, "minority_rows": 200_000, "benign_floor": 0.5, "time_bins": 100},
    "stream": {"strict_order": False, "watermark_s": 300, "trigger_s": 1},
    "experiment": {"name": None, "holdout_size": 3, "repeats": 5, "few_shot_n": [5, 10, 20, 50], "timeouts_s": [15, 30, 60, 120, 300, 600], "transfer_pairs": []},
}


def _merge(base: dict, more: dict, where: str = "") -> dict:
    out = copy.deepcopy(base)
    for k, v in more.items():
        if k not in out:
            raise KeyError(f"unknown setting {where + k!r}")
        out[k] = _merge(out[k], v, f"{where}{k}.") if isinstance(out[k], dict) and isinstance(v, dict) else v
    return out


def _parse(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return text


def _read(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


@dataclass(frozen=True)
class Scale:
    name: str
    seconds: int

    @property
    def ms(self) -> int:
        return self.seconds * 1000


def load(files: list[str] | None = None, overrides: list[str] | None = None) -> dict:
    """Settings after all layers, validated."""
    cfg = copy.deepcopy(DEFAULTS)
    for f in files or []:
        cfg = _merge(cfg, _read(f))
    for o in overrides or []:
        key, eq, value = o.partition("=")
        if not eq:
            raise ValueError(f"an override is key=value, not {o!r}")
        tree: Any = _parse(value)
        for part in reversed(key.split(".")):
            tree = {part: tree}
        cfg = _merge(cfg, tree)
    validate(cfg)
    return cfg


def scales(cfg: dict) -> list[Scale]:
    return [Scale(n, s) for n, s in cfg["graph"]["window_s"].items()]


def validate(cfg: dict) -> None:
    """Raises ValueError naming the first rule that a setting breaks."""
    g, m, d = cfg["graph"], cfg["model"], cfg["decide"]
    w = g["window_s"]
    quantile = lambda q: 0 < q < 1
    rules = {
        "graph.granularity is ip or ip_port": g["granularity"] in ("ip", "ip_port"),
        "graph.sampler is known": g["sampler"] in ("recency_stratified", "recent", "uniform"),
        "graph.window_s grows from short to long": 0 < w["short"] < w["mid"] < w["long"],
        "graph.anchor_bin_s is positive and at most the short window": 0 < g["anchor_bin_s"] <= w["short"],
        "graph.cap is at least graph.strata": g["cap"] >= g["strata"] >= 1,
        "model.aggregate is known": m["aggregate"] in ("mean", "trimmed", "soft_medoid"),
        "model.trim_beta is in [0, 0.5)": 0 <= m["trim_beta"] < 0.5,
        "model.norm is not a batch norm": m["norm"] in ("layer", "rms", "graph", "none"),
        "model.tau falls and stays above its minimum": m["tau_start"] >= m["tau_final"] > m["tau_min"] > 0,
        "model.dim is positive": m["dim"] > 0,
        "decide.*_quantile are in (0, 1)": quantile(d["unknown_quantile"]) and quantile(d["defer_quantile"]),
        "features.quantiles is at least 2": cfg["features"]["quantiles"] >= 2,
        "unsw_nb15 and bot_iot need ip_port nodes": cfg["data"]["dataset"] not in ("unsw_nb15", "bot_iot") or g["granularity"] == "ip_port",
    }
    for rule, ok in rules.items():
        if not ok:
            raise ValueError(f"settings: {rule}")
