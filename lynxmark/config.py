"""Thresholds and weights of the scores, and the file they can come from."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Band:
    warn: float
    crit: float


@dataclass(frozen=True)
class Cutoffs:
    """Verdict cut-offs; ``scale`` 100 for percentages, 1 for ratios."""

    dist_sakura: float
    dup_sakura: float
    dist_likely: float
    dup_likely: float
    dist_unlikely: float
    dup_unlikely: float = 0.0  # read, never compared


@dataclass(frozen=True)
class Thresholds:
    """All values as they stand without a file."""

    weights: dict[str, float] = field(default_factory=lambda: {"dist_bias": 0.35, "duplicates": 0.35, "surge": 0.20, "noise": 0.10})
    dist_bias: Band = Band(0.35, 0.60)
    duplicates: Band = Band(0.30, 0.50)
    surge_z: Band = Band(1.80, 3.00)
    noise: Band = Band(0.25, 0.50)
    ratio: Cutoffs = Cutoffs(0.80, 0.50, 0.65, 0.40, 0.45)
    feature_percent: dict[str, Band] = field(default_factory=lambda: {"dist_bias": Band(65, 80), "duplicates": Band(40, 55), "surge": Band(40, 65), "noise": Band(35, 55)})
    percent: Cutoffs = Cutoffs(80, 50, 65, 40, 45)


def parse_yaml(text: str) -> dict:
    """The subset that such files use: nested mappings by indentation, scalar values, comments."""
    root: dict = {}
    open_: list[tuple[int, dict]] = [(-1, root)]
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        depth = len(line) - len(line.lstrip())
        key, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(f"not a mapping: {raw!r}")
        while open_[-1][0] >= depth:
            open_.pop()
        value = value.strip().strip("'\"")
        if value:
            open_[-1][1][key.strip()] = value
        else:
            open_[-1][1][key.strip()] = child = {}
            open_.append((depth, child))
    return root


def _number(tree: dict, path: str, default: float) -> float:
    """The number at a dotted path; the default where it is missing or not a number."""
    at: object = tree
    for key in path.split("."):
        at = at.get(key) if isinstance(at, dict) else None
    try:
        return float(at)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default


def from_tree(tree: dict) -> Thresholds:
    d = Thresholds()
    band = lambda path, b: Band(_number(tree, f"{path}.warn", b.warn), _number(tree, f"{path}.crit", b.crit))
    r, p = d.ratio, d.percent
    return Thresholds(
        weights={k: _number(tree, f"weights.{k}", v) for k, v in d.weights.items()},
        dist_bias=band("dist_bias", d.dist_bias), duplicates=band("duplicates", d.duplicates), surge_z=band("surge_z", d.surge_z), noise=band("noise", d.noise),
        ratio=Cutoffs(*(_number(tree, f"sakura_judge.{k}", v) for k, v in (("dist_bias_sakura", r.dist_sakura), ("duplicate_sakura", r.dup_sakura), ("dist_bias_likely", r.dist_likely), ("duplicate_likely", r.dup_likely), ("dist_bias_unlikely", r.dist_unlikely)))),
        feature_percent={k: band(f"feature_percent.{k}", b) for k, b in d.feature_percent.items()},
        percent=Cutoffs(*(_number(tree, f"sakura_percent.{k}", v) for k, v in (("sakura.dist_bias", p.dist_sakura), ("sakura.duplicates", p.dup_sakura), ("likely.dist_bias", p.dist_likely), ("likely.duplicates", p.dup_likely), ("unlikely.dist_bias", p.dist_unlikely), ("unlikely.duplicates", p.dup_unlikely)))),
    )


class ThresholdSource:
    """Thresholds from a file that is read again when it changes; a file that cannot be read leaves the last ones in force."""

    def __init__(self, path: str | None = None):
        self.path, self.seen, self.last = path, None, Thresholds()

    def get(self) -> Thresholds:
        if not self.path or not os.path.isfile(self.path):
            return self.last
        stamp = os.stat(self.path).st_mtime_ns
        if stamp != self.seen:
            self.seen = stamp
            try:
                with open(self.path, encoding="utf-8") as f:
                    self.last = from_tree(parse_yaml(f.read()))
            except (OSError, ValueError):
                pass
        return self.last


def to_yaml(t: Thresholds) -> str:
    """A file that from_tree() reads back as ``t``."""
    out = ["weights:", *(f"  {k}: {v}" for k, v in t.weights.items())]
    for name in ("dist_bias", "duplicates", "surge_z", "noise"):
        b = getattr(t, name)
        out += [f"{name}:", f"  warn: {b.warn}", f"  crit: {b.crit}"]
    r, p = t.ratio, t.percent
    out += ["sakura_judge:", f"  dist_bias_sakura: {r.dist_sakura}", f"  duplicate_sakura: {r.dup_sakura}", f"  dist_bias_likely: {r.dist_likely}", f"  duplicate_likely: {r.dup_likely}", f"  dist_bias_unlikely: {r.dist_unlikely}"]
    out += ["feature_percent:", *(x for k, b in t.feature_percent.items() for x in (f"  {k}:", f"    warn: {b.warn}", f"    crit: {b.crit}"))]
    rows = (("sakura", p.dist_sakura, p.dup_sakura), ("likely", p.dist_likely, p.dup_likely), ("unlikely", p.dist_unlikely, p.dup_unlikely))
    out += ["sakura_percent:", *(x for k, a, b in rows for x in (f"  {k}:", f"    dist_bias: {a}", f"    duplicates: {b}"))]
    return "\n".join(out) + "\n"


def with_weights(t: Thresholds, **weights: float) -> Thresholds:
    if any(w < 0 for w in weights.values()):
        raise ValueError("a weight cannot be negative")
    return replace(t, weights=t.weights | weights)
