"""The metrics. Every function takes the donations and/or actions table and returns a lazy DataFrame."""
