"""Registered queries and whole jobs."""


def catalogue():
    """All registered queries by name."""
    import importlib

    from hazardlake.registry import QUERIES

    for part in ("feed", "maps", "texts", "scenes", "tiles", "scores", "masks", "files",
                 "streams", "learning"):
        importlib.import_module(f"hazardlake.plans.{part}_queries")
    return QUERIES
