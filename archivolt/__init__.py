"""Archivolt: DataFrame -> DataFrame operators for archives, media catalogues and text corpora."""
