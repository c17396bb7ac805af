"""Configuration: checked in full before any job runs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from sparklex.sources import files

_ALWAYS = object()
# What a configuration needs: (a setting, the value of it that asks for them or None for any that is set, settings).
NEEDS = (
    (_ALWAYS, None, ("system_name", "seed", "weights.hf_repo", "weights.subfolder", "stack", "mt.decode", "mt.exemplar_k", "mt.pool", "qa.slot_scorer", "gc.union", "gc.paradigm_cap", "sc.bktree", "sc.paradigm_cap", "mr.retry_ladder", "mr.postformat", "mr.retrieval")),
    ("gc.union", None, ("gc.witness.hsb.w", "gc.witness.hsb.t", "gc.witness.dsb.w", "gc.witness.dsb.t")),
    ("sc.topups.nonword.enabled", None, ("sc.topups.nonword.tau_hsb", "sc.topups.nonword.tau_dsb")),
    ("sc.topups.diacritic.hsb.enabled", None, ("sc.topups.diacritic.hsb.min_freq",)),
    ("sc.topups.diacritic.dsb.enabled", None, ("sc.topups.diacritic.dsb.min_freq",)),
    ("mr.retrieval.enabled", None, ("mr.retrieval.sim_threshold", "mr.retrieval.corpus")),
    ("stack", "composed", ("engine.batch", "engine.max_cand")),
)
STACKS = ("composed", "plain")
# Fitted settings, the defaults of our pipelines; None switches a top-up off.
DEFAULTS = {
    "exemplar_k": 3, "pool_cap": 60_000, "gc_paradigm_cap": 60, "sc_paradigm_cap": 30, "witness": {"hsb": {"w": 0.1, "t": 0.42}, "dsb": {"w": 0.4, "t": 0.76}},
    "diacritic": {"hsb": None, "dsb": 5}, "tau": {"hsb": 0.30, "dsb": 0.36}, "batch": 96, "max_cand": 24, "sim_threshold": 0.95, "seed": 1234, "max_new": {"mt": 320, "qa": 16, "sc": 64, "gc": 64, "mr": 640},
}


class ConfigError(ValueError):
    pass


def _need(ok: bool, where: str, what: str) -> None:
    if not ok:
        raise ConfigError(f"{where}: {what}")


_ABSENT = object()


def setting(config: dict, path: str, default=_ABSENT):
    """The value at a dotted path, or the default."""
    at = config
    for key in path.split("."):
        if not isinstance(at, dict) or key not in at:
            return default
        at = at[key]
    return at


def validate(config: dict, where: str = "<config>") -> dict:
    """The configuration as it is, or a ConfigError that names all that is missing."""
    lacking = []
    for switch, value, paths in NEEDS:
        got = True if switch is _ALWAYS else setting(config, switch, None)
        if (got if value is None else got == value) and got:
            lacking += [p for p in paths if setting(config, p) is _ABSENT]
    _need(not lacking, where, f"missing {sorted(lacking)}")
    _need(config["stack"] in STACKS, where, f"stack is {config['stack']!r}, none of {STACKS}")
    return config


def load(path: str) -> dict:
    """A YAML or JSON file, checked."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        config = yaml.safe_load(text)
    except ImportError:
        import json

        config = json.loads(text)
    return validate(config, path)


def expand(path: str, variables: dict[str, str]) -> str:
    """${NAME} replaced; an unknown name is an error."""

    def value(m: re.Match) -> str:
        _need(m.group(1) in variables, path, f"{m.group(1)} isn't set")
        return variables[m.group(1)]

    return re.sub(r"\$\{(\w+)\}", value, path)


@dataclass
class Resources:
    """Paths by name; a path is looked up at its first use, and an override wins."""

    paths: dict[str, str] = field(default_factory=dict)
    overrides: dict[str, str] = field(default_factory=dict)
    variables: dict[str, str] = field(default_factory=dict)

    def path(self, name: str) -> str:
        raw = self.overrides.get(name) or self.paths.get(name)
        _need(raw is not None, "resources", f"{name} missing")
        full = expand(raw, self.variables)
        _need(files.exists(full), "resources", f"{name}: {full} isn't there")
        return full
