"""Catalogue readers and report sinks.

A reader takes text columns by header name and gives typed rows; malformed rows are dropped, a missing required column
gives an empty result, and missing numbers are null (never NaN, which would pass any lower bound)."""
