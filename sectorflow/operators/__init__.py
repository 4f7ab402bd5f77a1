"""Lazy DataFrame transforms of the sector-hour panel."""
