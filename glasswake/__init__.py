"""Glasswake: web-exposure scanning and change review as Spark jobs.

Captured pages, headers, cookies, web storage, console lines, requests, asset
bodies and pull-request diffs come in as DataFrames; findings, inventories,
scenarios, scores and report rows go out as DataFrames.
"""
