"""The registered queries and their SQL twins."""

from quotalens.queries.registry import ORACLES, QUERIES  # noqa: F401


def load_all() -> None:
    import importlib
    import pkgutil

    import quotalens.queries as package

    for module in sorted(m.name for m in pkgutil.iter_modules(package.__path__)):
        if module not in ("registry", "base"):
            importlib.import_module(f"quotalens.queries.{module}")
