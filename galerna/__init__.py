"""Tropical-cyclone hazard analytics on Spark: rain climatologies, extremes, wind radii and a bounded hazard index."""
