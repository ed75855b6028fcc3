"""Medallion analytics and modelling for document-shaped entity data, on Spark."""
