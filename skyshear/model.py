"""Constants of the radar domain, in one place."""

from __future__ import annotations

#: Product directory codes with the quantity and resolution that they hold.
PRODUCTS = (
    ("019", "reflectivity", "high"), ("020", "reflectivity", "high"), ("026", "velocity", "high"), ("027", "velocity", "high"),
    ("158", "zdr", "high"), ("160", "rho", "high"), ("161", "phidp", "high"), ("162", "kdp", "high"),
    ("19", "reflectivity", "low"), ("20", "reflectivity", "low"), ("26", "velocity", "low"), ("27", "velocity", "low"),
)
#: Registered stations as code, latitude, longitude (degrees), height (m).
STATIONS = (("Z9317", 38.279, 116.805, 9.0), ("Z9543", 37.383, 117.933, 18.0), ("Z9532", 35.989, 120.230, 92.0), ("Z9539", 35.250, 118.421, 224.0))
#: WGS84: semi-major axis (km) and flattening.
EARTH_A, EARTH_F = 6378.137, 1 / 298.257223563
#: Reflectivity (dBZ) and red, green, blue of the colour scale.
COLOURS = (
    (-5, 0, 255, 255), (0, 180, 130, 220), (5, 0, 0, 205), (10, 30, 144, 255), (15, 0, 255, 127), (20, 0, 255, 0), (25, 0, 160, 0), (30, 173, 255, 47),
    (35, 255, 255, 0), (40, 200, 180, 0), (45, 255, 160, 122), (50, 255, 140, 0), (55, 255, 0, 0), (60, 230, 50, 230), (65, 160, 0, 200),
)
NYQUIST_FALLBACK = 30.0
MIN_ANGLE = 20.0
SCALE_HEIGHT = 10_000.0
MATCH_MINUTES = 2.0
#: Bin edges: crossing angle (degrees, last bin closed) and range (km, open above).
ANGLE_EDGES = (0, 10, 15, 20, 30, 45, 60, 90)
RANGE_EDGES = (0, 75, 100, 125, 150, 175, 200, 225, 250)
#: Quality gate: 99th percentile of |w| (m/s), 95th of the continuity residual (1/s).
W_P99, RESIDUAL_P95 = 15.0, 0.005
#: Rotation: least vorticity (1/s), heights (km), separation (km), layers, dBZ.
MESO = {"zeta": 0.005, "z_low": 1.0, "z_high": 5.0, "apart": 10.0, "layers": 3, "dbz": 30.0, "most": 5}
#: Steps of the projected grid (m) and the places of its two radars (x, y, z in m).
DX = DY = 5000.0
DZ = 500.0
RADARS = ((-50_000.0, 0.0, 0.0), (50_000.0, -30_000.0, 0.0))
