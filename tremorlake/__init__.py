"""Seismicity analytics on Spark: catalogues, declustering, matched designs, score tests, circular statistics."""
