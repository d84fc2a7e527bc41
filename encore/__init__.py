"""Playlist analytics and automatic playlist continuation on Spark DataFrames."""
