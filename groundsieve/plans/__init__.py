"""End-to-end plans and the registered queries with their check SQL."""

import importlib
import importlib.util

_MODULES = ("flagship", "ingest", "keys", "legends", "profiles", "folds", "metrics", "calibrated",
            "thresholded", "nearby", "grids", "learned", "survivors")


def load_all() -> None:
    """Import every plan module, which registers its queries."""
    for name in _MODULES:
        if importlib.util.find_spec(f"{__name__}.{name}"):
            importlib.import_module(f"{__name__}.{name}")
