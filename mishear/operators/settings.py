"""Settings of runs, on the driver: checked, filled in, written into templates."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import PurePosixPath

#: The instruction fields that an engine takes.
PARAMETERS = {"qwen3-tts": ("instruct",), "azure": ("ssml_template",), "cosyvoice3": ("instruct",), "cosyvoice3-api": ("instruct",)}
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


@dataclass(frozen=True)
class Sampling:
    temperature: float = 0.0
    top_p: float = 1.0
    top_k: int = 0
    min_p: float = 0.0
    seed: int | None = None

    def __post_init__(self) -> None:
        if self.temperature < 0 or not 0 <= self.top_p <= 1 or self.top_k < 0 or not 0 <= self.min_p <= 1:
            raise ValueError(f"invalid sampling {self}")


def sampling(condition: Mapping) -> Sampling:
    return Sampling(float(condition.get("temperature", 0)), float(condition.get("top_p", 1)), int(condition.get("top_k", 0)), float(condition.get("min_p", 0)), condition.get("seed"))


def of_condition(experiment: Mapping, condition: Mapping, key: str, default=None):
    """A condition's own value, null included, else the experiment's."""
    return condition[key] if key in condition else experiment.get(key, default)


def substituted(text: str, values: Mapping[str, object]) -> str:
    """A YAML text with the values of scalar keys replaced; each key has to be there, its first line counts."""
    lines = text.split("\n")
    for key, value in values.items():
        shown = "null" if value is None else str(value).lower()
        at = next((k for k, line in enumerate(lines) if line.lstrip().startswith(f"{key}:")), None)
        if at is None:
            raise ValueError(f"no field {key}")
        head = lines[at][: lines[at].index(":") + 1]
        gap = re.match(r"\s*", lines[at][len(head) :])[0]
        lines[at] = head + (gap or "") + shown
    return "\n".join(lines)


def in_log(log: str, wanted: Sampling, tolerance: float = 1e-9) -> bool:
    """Whether a line of a log states these settings, numbers by value."""
    fields = ("temperature", "top_p", "top_k", "min_p", "seed")
    pattern = ".*?".join(rf"{f}\W{{1,3}}(-?[\w.]+)" for f in fields)
    for found in re.findall(pattern, log):
        *numbers, seed = found
        try:
            near = all(abs(float(a) - float(getattr(wanted, f))) <= tolerance for a, f in zip(numbers, fields))
        except ValueError:
            continue
        if near and seed == str(wanted.seed):
            return True
    return False


def duration(seconds: float, units: bool = False) -> str:
    """``MM:SS`` or ``H:MM:SS``; with units ``1h02m03s``."""
    total = max(0, round(seconds))
    h, m, s = total // 3600, total // 60 % 60, total % 60
    if units:
        return f"{h}h{m:02d}m{s:02d}s" if h else f"{m}m{s:02d}s"
    return f"{h}:{m:02d}:{s:02d}" if h else f"{m:02d}:{s:02d}"


def endpoint(url: str) -> str:
    """A chat endpoint for a base address."""
    url = url.rstrip("/")
    if url.endswith("/chat/completions"):
        return url
    return f"{url}/chat/completions" if url.endswith("/v1") else f"{url}/v1/chat/completions"


def candidates(path: str, manifest: str, root: str) -> list[str]:
    """Where a manifest's relative audio path may lie, in order: beside it, one up, below the root."""
    if PurePosixPath(path).is_absolute():
        return [path]
    folder = PurePosixPath(manifest).parent
    return [str(base / path) for base in (folder, folder.parent, PurePosixPath(root))]


def rebased(path: str | None, manifest: str, root: str, exists) -> str | None:
    """The first place at which a manifest's audio is, relative to the root if below it; else the path as it was."""
    if not path or not path.strip():
        return path
    found = next((c for c in candidates(path, manifest, root) if exists(c)), None)
    if found is None:
        return path
    parts: list[str] = []
    for p in PurePosixPath(found).parts:
        if p == ".." and parts:
            parts.pop()
        elif p != ".":
            parts.append(p)
    whole = PurePosixPath(*parts)
    return str(whole.relative_to(root)) if whole.is_relative_to(root) else str(whole)


@dataclass(frozen=True)
class Instruction:
    name: str
    tags: tuple[str, ...] = ()
    parameters: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Engine:
    engine: str
    voices: tuple[str, ...]
    instructions: tuple[Instruction, ...]


def engine(config: Mapping) -> Engine:
    """A checked engine configuration: a known engine, voices, and instructions with the fields that it takes."""
    name = str(config.get("engine", "")).strip().lower()
    if name not in PARAMETERS:
        raise ValueError(f"unknown engine {name!r}")
    design = name == "qwen3-tts" and str(config.get("mode", "custom_voice")).lower() == "voice_design"
    if design and "speakers" in config:
        raise ValueError("a voice that is designed has no speakers")
    listed = [{"name": "instruction-defined"}] if design else config.get("speakers") if name == "qwen3-tts" else config.get("voices") if name == "azure" else [config.get("voice", {"name": "reference"})]
    voices = tuple(str(v.get("name", "")).strip() for v in listed or ())
    if not voices or not all(voices):
        raise ValueError("voices need names")
    instructions = tuple(_instruction(i, PARAMETERS[name]) for i in config.get("instructions") or ())
    names = [i.name for i in instructions]
    if not names or len(set(names)) < len(names):
        raise ValueError("instructions need names that differ")
    if design and not all(i.parameters.get("instruct") for i in instructions):
        raise ValueError("a voice that is designed needs instructions")
    return Engine(name, voices, instructions)


def _instruction(value: Mapping, allowed: Iterable[str]) -> Instruction:
    name = str(value.get("name", "")).strip()
    if not NAME.fullmatch(name):
        raise ValueError(f"invalid instruction name {name!r}")
    if unknown := set(value) - {"name", "tags", *allowed}:
        raise ValueError(f"unknown instruction fields {sorted(unknown)}")
    return Instruction(name, tuple(s for s in map(str.strip, map(str, value.get("tags", ()))) if s), {k: value[k] for k in allowed if value.get(k) is not None})
