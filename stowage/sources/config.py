"""Settings of a collection: a file of known keys, overruled by what a caller gives."""

from __future__ import annotations

from pathlib import Path

#: Known settings and their defaults.
DEFAULTS = {"bucket_name": None, "repo_prefix": None, "endpoint_url": None, "no_sign_request": False, "use_acceleration": False, "max_workers": None}
NAMES = (".stowage.yaml", ".stowage.yml")


def find(start: str) -> Path | None:
    """The nearest settings file at or above a folder."""
    here = Path(start).resolve()
    return next((d / n for d in (here, *here.parents) for n in NAMES if (d / n).is_file()), None)


def load(path: str | Path) -> tuple[dict, list[str]]:
    """Known settings of a file over the defaults, and the unknown keys, which are left out."""
    import yaml

    found = yaml.safe_load(Path(path).read_text()) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} is not a mapping")
    return DEFAULTS | {k: v for k, v in found.items() if k in DEFAULTS}, sorted(set(found) - set(DEFAULTS))


def apply(given: dict, settings: dict) -> dict:
    """What a caller gives, where it says anything, else the settings, else the defaults."""
    return {k: given.get(k) or settings.get(k, default) for k, default in DEFAULTS.items()}
