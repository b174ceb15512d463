"""Configuration: defaults < YAML file < environment < flags."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from arborfold.plans.safety import write_atomic

FILE_NAME = ".arborfold.yaml"
ENV_MODEL, ENV_URL, ENV_CONTEXT = "ARBORFOLD_MODEL_ID", "ARBORFOLD_BASE_URL", "ARBORFOLD_NUM_CTX"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    name: str
    prompt: str


STEPS = (
    Step("PURPOSE", "In three sentences at most: what is this file for, and who calls on it?"),
    Step("ENTRY_POINTS", "Give a table of what other files may use: name, inputs, outputs, one line of meaning each."),
    Step("DATA", "Trace the data: where it comes from, the shapes it takes, what is stored, and which parts of it change during a run."),
    Step("DEPENDENCIES", "Name the files, services and settings that this file relies on, and what for."),
    Step("FAILURE", "Tell what can go wrong at run time, what is done about it here, and what is left to callers."),
)


@dataclass(frozen=True)
class Config:
    model_id: str = "qwen2.5:7b"
    base_url: str = "http://localhost:11434"
    num_ctx: int = 8192
    docs_dir: str = "wiki"
    system_prompt: str = "You write exact technical documentation. State only what the given text shows."
    module_synthesis_prompt: str = "Write the documentation page of a module from the list of its parts, grouped under headings, with its responsibility and data flow."
    architecture_prompt: str = "Write an overview of the whole system from the summaries of its modules: its boundaries and how its modules work together."
    file_fact_consolidation_prompt: str = "Merge these facts from parts of one file into one summary without repetition."
    extraction_steps: tuple[Step, ...] = STEPS
    ignore: tuple[str, ...] = field(default=())

    @property
    def steps(self) -> list[tuple[str, str]]:
        return [(s.name, s.prompt) for s in self.extraction_steps]


def deduplicate(values: Iterable[str]) -> list[str]:
    """First occurrences, in order."""
    return list(dict.fromkeys(values))


def load(folder: str | Path) -> Config:
    """The file's values over the defaults; unknown keys are left out, empty ones have the default."""
    import yaml

    path = Path(folder, FILE_NAME)
    if not path.exists():
        raise ConfigError(f"there is no {path}")
    try:
        raw = yaml.safe_load(path.read_text()) or {}
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} is not valid YAML: {e}") from e
    if not isinstance(raw, Mapping):
        raise ConfigError(f"{path} is not a mapping")
    known = {k: v for k, v in raw.items() if k in Config.__dataclass_fields__ and v}
    try:
        if "extraction_steps" in known:
            known["extraction_steps"] = tuple(Step(str(s.get("name", "")), str(s.get("prompt", ""))) for s in known["extraction_steps"])
        if "ignore" in known:
            known["ignore"] = tuple(deduplicate(map(str, known["ignore"])))
        if "num_ctx" in known:
            known["num_ctx"] = int(known["num_ctx"])
            if known["num_ctx"] <= 0:
                del known["num_ctx"]
        for name, f in Config.__dataclass_fields__.items():
            if f.type == "str" and name in known:
                if not isinstance(known[name], (str, int, float)):
                    raise TypeError(f"{name} is no text")
                known[name] = str(known[name])
    except (AttributeError, TypeError, ValueError) as e:
        raise ConfigError(f"{path} has values of a wrong kind: {e}") from e
    return Config(**known)


def save(folder: str | Path, config: Config) -> None:
    """Readable by its owner only; a blank line before each long section."""
    import yaml

    raw = asdict(config) | {"extraction_steps": [asdict(s) for s in config.extraction_steps], "ignore": list(config.ignore)}
    text = yaml.safe_dump(raw, sort_keys=False, allow_unicode=True, width=1_000_000)
    apart = ("system_prompt:", "module_synthesis_prompt:", "architecture_prompt:", "file_fact_consolidation_prompt:", "extraction_steps:", "ignore:")
    lines = [f"\n{x}" if x.startswith(apart) else x for x in text.splitlines()]
    write_atomic(Path(folder, FILE_NAME), ("\n".join(lines) + "\n").encode(), 0o600)


def _positive(value: str | int, source: str) -> int:
    try:
        n = int(value)
    except ValueError:
        n = 0
    if n <= 0:
        raise ConfigError(f"{source} must be a positive number, not {value!r}")
    return n


def resolve(folder: str | Path, env: Mapping[str, str] = os.environ, model_id: str = "", num_ctx: str = "") -> Config:
    """All tiers; a bad number in the environment is an error even if the flag is set."""
    config = load(folder) if Path(folder, FILE_NAME).exists() else Config()
    changed: dict = {}
    if env.get(ENV_MODEL):
        changed["model_id"] = env[ENV_MODEL]
    if env.get(ENV_URL):
        changed["base_url"] = env[ENV_URL]
    if env.get(ENV_CONTEXT):
        changed["num_ctx"] = _positive(env[ENV_CONTEXT], ENV_CONTEXT)
    if model_id:
        changed["model_id"] = model_id
    if num_ctx:
        changed["num_ctx"] = _positive(num_ctx, "--num-ctx")
    return replace(config, **changed)
