"""Importing this module registers every query."""

from escarp.plans import (  # noqa: F401
    model_queries,
    patch_queries,
    proximity_queries,
    raster_queries,
    scene_queries,
    tree_queries,
)
