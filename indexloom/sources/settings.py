"""Settings in nested JSON and the places of inputs and outputs."""

from __future__ import annotations

from pathlib import Path
from typing import Any


def setting(config: dict, section: str, key: str, default: Any = None) -> Any:
    """``config[section][key]["value"]``; falsy values count, what is missing gives the default."""
    found = config.get(section, {}) if isinstance(config, dict) else {}
    found = found.get(key, {}) if isinstance(found, dict) else {}
    return found.get("value", default) if isinstance(found, dict) else default


#: Where files are unless the settings say otherwise.
DEFAULTS = {"prices": "synthetic_data/prices_monthly.csv", "weights": "synthetic_data/market_index_weights.csv", "basis": "outputs/basis_selected.csv", "coefficients": "outputs/coefficients_ridge_panel.csv"}


def locations(config: dict, root: str, make: bool = False) -> dict[str, str]:
    """Paths of outputs, prices, weights, basis and coefficients, below ``root`` unless the settings give absolute ones.

    A file is looked up as ``<name>_path`` and as ``<name>``, in the sections input, output and paths, in that order; an empty
    value counts as none.  With ``make`` the folder of the outputs is made.
    """
    out = Path(root) / (setting(config, "output", "folder") or "outputs")
    found = {"outputs": str(out)}
    for name, default in DEFAULTS.items():
        given = (setting(config, section, key) for section in ("input", "output", "paths") for key in (f"{name}_path", name))
        path = next((p for p in given if p), None)
        if path is None:
            path = str(out / Path(default).name) if default.startswith("outputs/") else default
        found[name] = str(Path(root) / path)
    if make:
        out.mkdir(parents=True, exist_ok=True)
    return found
