"""Sector-hour analytics on Spark: lazy DataFrame transforms over events and observations."""
