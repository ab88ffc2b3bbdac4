"""pingscape: co-location and tile analytics over GPS pings, written as Spark DataFrame plans.

Layout
------
functions/  column expressions (projections, distances, point-in-polygon, time, tile maths)
sources/    readers (CSV points, shapefiles) and the derived test fixtures
operators/  DataFrame -> DataFrame operators (cell joins, filters, aggregates, rasters)
plans/      the named analyses, built from operators, plus their DuckDB oracles
sinks/      writers (CSV, partitioned, text, tile tables)
"""

__version__ = "0.1.0"
