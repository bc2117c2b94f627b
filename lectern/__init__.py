"""Lectern: search, curation and analytics of a document library on PySpark."""
