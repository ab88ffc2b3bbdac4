"""Parameters of the registered analyses (the values the reference reads from
its property files: time bounds, radii, top-k size, grid size, zoom range).

Both the Spark plans and the DuckDB oracle read them from here.
"""

from __future__ import annotations

# time bounds, 'yyyy-MM-dd HH:mm:ss', wall time in the zone below
FROM_TIME = "2024-01-02 06:30:00"
TO_TIME = "2024-01-27 18:00:00"
# the whole fixture month, for the hourly grid
GRID_FROM_TIME = "2024-01-01 00:00:00"
GRID_TO_TIME = "2024-01-31 00:00:00"
# a stretch of the wide pings, for the grid with empty hours
WIDE_GRID_FROM_TIME = "2024-06-01 00:00:00"
WIDE_GRID_TO_TIME = "2024-07-16 00:00:00"
# zone offset of the wall time, ms (0 = UTC)
OFFSET_MS = 0

# radii in Mercator metres
POI_RADIUS = 500.0  # pings around a POI
CASE_RADIUS = 2000.0  # POI to infected place
EXPOSURE_RADIUS = 800.0  # pings around an exposed POI
EXPOSURE_DAYS = 10
ROAD_RADIUS = 300.0  # road buffer

FIRST_X = 10  # top-k size
NUM_PARTITIONS = 16  # equal grid: floor(sqrt(16)) = 4 cells per axis
MORNING_HOUR = 8
WINTER_MONTHS = (12, 1, 2)

MIN_ZOOM = 9
MAX_ZOOM = 14
TILE_ZOOM = 14  # zoom of the tile-corner query
HEAT_BLUR = 1
HEAT_CAP = 2.0

# The hourly-grid box (lng_min, lat_min, lng_max, lat_max) and the
# Beijing box in Mercator metres (x_min, y_min, x_max, y_max).
GRID_BOX = (115.8528796421, 39.59634, 116.94819, 40.3898263)
BEIJING_BOX_3857 = (1.2900283340426097e7, 4807455.730608667, 1.3017686759110853e7, 4915931.87752231)
