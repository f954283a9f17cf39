"""The specification of an audit: defaults, loading, validation that names every problem, warnings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from tidemark.functions.columns import key_template, valid_glob

#: What a template of keys can name, and the column of each.
KEY_FIELDS = {"Key": "key", "Publisher": "publisher", "Member": "member", "Epoch": "epoch"}
UNITS = {"ns": 0.001, "us": 1, "µs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}


def duration(x) -> int:
    """Microseconds of 1h30m, 250ms and the like, or of a bare number of seconds."""
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return int(x * 1_000_000)
    text = str(x)
    if re.fullmatch(r"-?[0-9.]+", text):
        return int(float(text) * 1_000_000)
    parts = re.findall(r"([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(n + u for n, u in parts) != text.lstrip("+-"):
        raise ValueError(f"not a duration: {text}")
    return int(sum(float(n) * UNITS[u] for n, u in parts)) * (-1 if text.startswith("-") else 1)


@dataclass
class Policy:
    """The defaults of an audit; durations in microseconds."""

    window_us: int = 5_000_000
    min_window_us: int = 1_000_000
    max_window_us: int = 120_000_000
    safety: float = 3.0
    mode: str = "static"
    sweep_us: int = 30_000_000
    extras_us: int = 300_000_000
    reorder_us: int = 2_000_000
    ttl_tolerance_us: int = 5_000_000
    bootstrap: str = "Adopt"
    expiry: str = "strict"
    assumed_ttl_us: int = 0
    max_keys: int = 1_000_000
    ring: int = 16
    max_queue: int = 10_000
    max_findings: int = 10_000
    max_extras: int = 100_000
    max_publishers: int = 1024
    never_settled: float = 10.0
    max_members: int = 100_000
    max_payload: int = 1 << 20
    batch: int = 500


@dataclass
class Spec:
    source: dict = field(default_factory=dict)
    codec: dict = field(default_factory=lambda: {"type": "json"})
    projection: dict = field(default_factory=lambda: {"type": "scalar"})
    target: dict = field(default_factory=dict)
    policy: Policy = field(default_factory=Policy)
    alert: dict = field(default_factory=lambda: {"keys": 10, "ratio": 0.001, "for_us": 60_000_000, "include_suspect": False})

    def problems(self) -> list[str]:
        """Everything that is wrong, not only the first of it."""
        p, found = self.policy, []

        def need(ok: bool, what: str) -> None:
            if not ok:
                found.append(what)

        need(self.source.get("type") in ("file", "file_stream", "frames", "memory", "kafka"), "source.type must be file, file_stream, frames, memory or kafka")
        need(self.codec.get("type") in ("json", "template", "msgpack"), "codec.type must be json, template or msgpack")
        need(self.codec.get("type") != "template" or bool(self.codec.get("pattern")), "codec.pattern is required for template")
        need(self.projection.get("type") in ("scalar", "set", "counter"), "projection.type must be scalar, set or counter")
        need(not self.source.get("queue_group"), "source.queue_group must be empty: every event is needed")
        need(p.min_window_us <= p.window_us <= p.max_window_us, "policy: min_window <= window <= max_window must hold")
        need(p.safety >= 1, "policy.safety must be 1 or more")
        need(p.sweep_us >= 1_000_000 and p.extras_us >= 1_000_000, "policy.sweep and policy.extras must be a second or more")
        need(p.bootstrap in ("Adopt", "Wait", "Strict"), "policy.bootstrap must be Adopt, Wait or Strict")
        need(p.bootstrap != "Strict" or bool(self.codec.get("snapshots", True)), "policy.bootstrap Strict needs snapshot operations")
        need(p.expiry in ("strict", "ignore", "model"), "policy.expiry must be strict, ignore or model")
        need(p.expiry != "ignore" or p.assumed_ttl_us > 0, "policy.expiry ignore needs assumed_ttl")
        need(1000 <= p.max_keys <= 100_000_000, "policy.max_keys must be from 1 thousand to 100 million")
        need(p.mode in ("static", "adaptive"), "policy.mode must be static or adaptive")
        need(p.reorder_us >= 0, "policy.reorder must not be negative")
        need(min(p.max_queue, p.max_findings, p.max_extras, p.max_members, p.max_payload) >= 1, "policy: max_queue, max_findings, max_extras, max_members and max_payload must be 1 or more")
        timed = self.target.get("lifetimes")
        need(timed in (None, True, False), "target.lifetimes must be true or false")
        need(bool(timed) or p.ttl_tolerance_us == 5_000_000, "policy.ttl_tolerance needs target.lifetimes: other snapshots of a store have no lifetimes to compare")
        need(p.ttl_tolerance_us >= 0, "policy.ttl_tolerance must not be negative")
        need(not timed or self.projection.get("type") == "scalar", "target.lifetimes needs a scalar projection")
        need(p.batch == 500, "policy.batch can not be set: a store is read as a table")
        need(1 <= p.ring <= 1024, "policy.ring must be from 1 to 1024")
        need(p.max_publishers >= 1 and p.never_settled >= 1, "policy.max_publishers and policy.never_settled must be 1 or more")
        owner = self.projection.get("ownership")
        need(self.projection.get("partitioned") is not True or bool(owner), "projection.ownership is required if keys are partitioned")
        need(not owner or valid_glob(owner.replace("{{.Publisher}}", "p")), "projection.ownership is not a pattern")
        try:
            key_template(self.projection.get("key", ""), dict.fromkeys(KEY_FIELDS))
        except ValueError as e:
            need(False, f"projection.key: {e}")
        return found

    @property
    def ownership(self) -> str | None:
        """The pattern of a publisher's keys, if keys are partitioned among publishers."""
        return self.projection.get("ownership") if self.projection.get("partitioned") else None

    @property
    def tolerance_us(self) -> int | None:
        """By how much lifetimes may differ; None if they are not compared, as the store does not tell them or expiry is ignored."""
        return self.policy.ttl_tolerance_us if self.target.get("lifetimes") and self.policy.expiry != "ignore" else None

    @property
    def commutative(self) -> bool:
        """Whether the order of changes does not matter, so that nothing has to wait for another."""
        return self.projection.get("type") == "counter" and bool(self.projection.get("incr_only"))

    def warnings(self) -> list[str]:
        found = []
        if self.policy.sweep_us < 2 * self.policy.window_us:
            found.append("sweeps follow each other closer than two windows")
        if self.projection.get("type") == "counter" and not self.projection.get("incr_only"):
            found.append("a counter that can be set is not commutative")
        return found


def load(text: str) -> Spec:
    """A specification from YAML; unknown settings and all problems are named in one error."""
    import yaml

    raw = yaml.safe_load(text) or {}
    known, errors = {f.name for f in fields(Policy)}, []
    policy = {}
    for k, v in (raw.get("policy") or {}).items():
        name = k if k in known else f"{k}_us"
        if name not in known:
            errors.append(f"policy.{k} is unknown")
            continue
        try:
            policy[name] = duration(v) if name.endswith("_us") else v
        except ValueError as e:
            errors.append(f"policy.{k}: {e}")
    errors += [f"{k} is unknown" for k in raw if k not in {f.name for f in fields(Spec)}]
    given = {k: v for k, v in raw.items() if k in ("source", "codec", "projection", "target", "alert")}
    spec = Spec(**given, policy=Policy(**policy))
    errors += spec.problems()
    if errors:
        raise ValueError("; ".join(errors))
    return spec


#: What can not change while an audit runs.
FIXED = (("projection", "type"), ("target", "type"))


def update_problems(old: Spec, new: Spec) -> list[str]:
    return [f"{a}.{b} can not change" for a, b in FIXED if getattr(old, a).get(b) != getattr(new, a).get(b)]
