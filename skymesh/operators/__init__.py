"""Cube, station, time and model operators on DataFrames."""
