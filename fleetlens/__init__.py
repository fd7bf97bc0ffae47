"""Inventory, health and metrics analytics for container clusters, on Spark DataFrames."""

from fleetlens.session import build_session

__all__ = ["build_session"]
