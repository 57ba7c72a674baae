"""End-to-end plans and the registered query catalogue."""

from .registry import ORACLES, QUERIES  # noqa: F401


def load_all() -> None:
    """Import every query module so that the registry is complete."""
    import importlib
    for mod in ("q_pages", "q_catalog", "q_extract", "q_products", "q_flat", "q_crawl"):
        importlib.import_module(f"{__name__}.{mod}")
