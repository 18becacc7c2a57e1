"""Intentionally empty.

The survey workload has no stream source, watermark, event-time window or streaming state:
waves arrive as whole yearly files and are processed as batch DataFrames. Nothing here.
"""
