"""Spark-native preparation, windowing and scoring of irregular sensor series."""

from stepgrid.series import SeriesSpec

__all__ = ["SeriesSpec"]
