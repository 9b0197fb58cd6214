"""Gridloom: visual-layout analytics on Spark DataFrames.

Images are pixel tables, regions and boxes are rows, embeddings are array
columns.  Every operator is a function DataFrame -> DataFrame.
"""
