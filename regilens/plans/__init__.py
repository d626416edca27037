"""Plans: the clean star-schema build and the catalogue of named queries."""

from regilens.plans.star import Star, StagedStar, build_star, fixture_star, materialise, save_tables

__all__ = ["Star", "StagedStar", "build_star", "fixture_star", "materialise", "save_tables"]
