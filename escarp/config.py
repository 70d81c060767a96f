"""Fixed values and defaults; every operator takes them as named arguments."""

# fixed values: thresholds, grid extent and sampling parameters
STEEP_DEGREES = 70
MIN_HEIGHT_M = 50
XMIN, XMAX, DX = -125, -102, 0.25
YMIN, YMAX, DY = 31, 49, 0.25
PATCH_PIXELS = 15
SAMPLE_FRACTION = 0.003
N_SHARDS = 100

# fixed values: join and zone radii
MATCH_RADIUS_M = 300
VICINITY_RADIUS_M = 800
PROBE_RADIUS_M = 500
POPULATION_RADII_KM = (30, 60, 100)
ROAD_RADII_M = (500, 1000, 1500, 2000)

# fixed values: percentiles and classes
SLOPE_PERCENTILES = (10, 20, 30, 40, 50, 60, 70, 80, 90)
BAND_PERCENTILES = (20, 35, 50, 65, 80)
BANDS = ("B7", "B6", "B2", "B4", "B5")
BAND_RATIOS = {"B42": ("B4", "B2"), "B65": ("B6", "B5"), "B67": ("B6", "B7")}
LITHOLOGY = {
    1: "geology_carbonate",
    3: "geology_non_carbonate",
    5: "geology_silicic_residual",
    8: "geology_colluvial_sediment",
    11: "geology_glacial_till_coarse",
    19: "geology_alluvium",
}
WINTER_TYPES = ("mixed", "ice", "snow")
