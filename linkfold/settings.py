"""Thresholds, weights and switches of the resolution pipeline, with their clamping rules."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

#: The pool sizes that may be asked for; anything else becomes the last.
POOL_SIZES = (10, 20, 30, 40)


@dataclass(frozen=True)
class Settings:
    """Every field is a literal of a plan; nothing here is data."""

    top_n: int = 10
    match_threshold: float = 0.11
    similar_threshold: float = 0.08
    dead_threshold: float = 0.10
    weight_text: float = 0.65
    weight_cosine: float = 0.45
    empty_text_cosine: float = 0.86
    bypass_cosine: float = 0.90
    bypass_score: float = 0.70
    reuse_min_cosine: float = 0.50
    analog_min_cosine: float = 0.70
    reuse_previous: bool = True

    @classmethod
    def parse(cls, raw: dict) -> Settings:
        """Unknown keys are dropped, bad values replaced by defaults, numbers clamped, and similar kept at or below match."""
        out = {}
        for f in fields(cls):
            value, default = raw.get(f.name, f.default), f.default
            if isinstance(default, bool):
                out[f.name] = value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
            elif isinstance(default, int):
                out[f.name] = value if value in POOL_SIZES else POOL_SIZES[-1]
            else:
                try:
                    number = float(value)
                except (TypeError, ValueError):
                    number = default
                out[f.name] = round(min(1.0, max(0.0, number if number == number else default)), 2)
        out["similar_threshold"] = min(out["similar_threshold"], out["match_threshold"])
        return cls(**out)

    def patched(self, patch: dict) -> Settings:
        """These settings with a patch merged in and checked again."""
        return Settings.parse(asdict(self) | patch)

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=1)

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path) as f:
            return cls.parse(json.load(f))

    def with_pool(self, n: int) -> Settings:
        return replace(self, top_n=n if n in POOL_SIZES else POOL_SIZES[-1])


#: Parts of names whose values aren't shown.
SECRET = ("key", "token", "secret", "password")


def public_view(raw: dict) -> dict[str, dict]:
    """Each setting of a raw table by name: its checked value, its default and whether it was changed; what isn't a setting is left out, but secrets are named, masked to their last four characters."""
    checked = Settings.parse(raw)
    out = {f.name: {"value": getattr(checked, f.name), "default": f.default, "changed": getattr(checked, f.name) != f.default} for f in fields(Settings)}
    for name, value in raw.items():
        if name not in out and any(s in name.lower() for s in SECRET):
            text = str(value or "")
            out[name] = {"set": bool(text), "value": "***" + text[-4:] if len(text) > 8 else "***" if text else ""}
    return out
