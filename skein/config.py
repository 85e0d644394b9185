"""Fixed values of the message model: windows, weights, verdict bands and safety rules."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields

TEAM_WINDOW = 600.0
MIN_TEAM_SIZE = 2
VERDICTS = ("ALLOW", "WARN", "THROTTLE", "ISOLATE", "TERMINATE")
BANDS = ((0.40, "ALLOW"), (0.65, "WARN"), (0.80, "THROTTLE"), (0.92, "ISOLATE"))
FAMILIES = ("topology", "semantic", "privilege", "sidechannel", "cascade")
WEIGHT = 0.2
THROTTLE_CAPACITY = 10.0
THROTTLE_REFILL = 1.0
COOLDOWN = 60.0
RETENTION_DAYS = 365
ESCALATION_PAIRS = (("read-untrusted", "write-trusted"), ("code-exec", "net-egress"), ("memory-write", "identity-assumption"))
HIGH_RISK = ("read-untrusted", "code-exec", "memory-write", "identity-assumption")
HIGH_RISK_THRESHOLD = 3
#: Scalars that the environment may set, as SKEIN_ and the name in capitals.
FROM_ENVIRONMENT = ("team_window", "min_team_size", "throttle_capacity", "throttle_refill", "cooldown_interval", "retention_days")


@dataclass(frozen=True)
class Settings:
    team_window: float = TEAM_WINDOW
    min_team_size: int = MIN_TEAM_SIZE
    bands: tuple = BANDS
    weights: tuple = (WEIGHT,) * len(FAMILIES)
    throttle_capacity: float = THROTTLE_CAPACITY
    throttle_refill: float = THROTTLE_REFILL
    cooldown_interval: float = COOLDOWN
    retention_days: int = RETENTION_DAYS

    @classmethod
    def resolve(cls, given: dict | None = None, path: str | None = None, environ: dict | None = None) -> Settings:
        """What is given goes before the environment, that before the file (YAML or JSON; SKEIN_CONFIG names one), that before the defaults.
        Unknown names are left out; weights in a file are a mapping of family to weight."""
        environ = os.environ if environ is None else environ
        path = path or environ.get("SKEIN_CONFIG")
        found = _read(path) if path and os.path.exists(path) else {}
        found |= {k: environ[f"SKEIN_{k.upper()}"] for k in FROM_ENVIRONMENT if f"SKEIN_{k.upper()}" in environ}
        found |= given or {}
        if isinstance(found.get("weights"), dict):
            found["weights"] = tuple(float(found["weights"].get(f, WEIGHT)) for f in FAMILIES)
        if "bands" in found:
            found["bands"] = tuple((float(upto), str(name)) for upto, name in found["bands"])
        types = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: types[k](v) for k, v in found.items() if k in types})


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return json.loads(text or "{}")
    return yaml.safe_load(text) or {}
