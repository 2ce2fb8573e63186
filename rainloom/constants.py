"""Fixed values shared by every operator.

Everything here is a published constant of the data products or of the
climatology definition; operators take them as keyword defaults.
"""

# Detection: near-surface reflectivity floor (dBZ) of each radar.
DBZ_FLOOR = {"GPM": 12.0, "TRMM": 16.0}
DBZ_FLOOR_DEFAULT = 12.0
MIN_AREA_KM2 = 0.0
MIN_PIXELS = 1
MCS_AREA_KM2 = 2000.0

MISSION_CODE = {"TRMM": 1, "GPM": 2}

# feature_id = mission_code * 1e13 + orbit * 1e5 + local_label
ID_ORBIT_MULT = 100_000
ID_MISSION_MULT = 10_000_000_000_000

# Preferred data version per product.
PRODUCT_VERSION = {
    "GPM_2AKu": "07",
    "GPM_2ADPR": "07",
    "GPM_2APR": "07",
    "GPM_1CGPMGMI": "08",
    "GPM_1CTRMMTMI": "08",
}
PRODUCT_VERSION_DEFAULT = "07"

# Range bins.
BIN_SIZE_M = 125.0
N_BINS = 176

EARTH_RADIUS_KM = 6371.0

# Polarisation-corrected temperature coefficients, (a, b) in a*V - b*H.
PCT_85_89 = (1.818, 0.818)
PCT_37 = (2.15, 1.15)

# Imager co-location.
COLOCATE_RADIUS_M = 15000.0
PARALLAX_STORMTOP_M = 5000.0
PARALLAX_PIA_DB = 0.4

# Fill values. -99 is a valid longitude, so geolocation has its own list.
FILL_SENTINELS = (-9999.9, -9999.0, -99.0, -1111.1, -1111.0)
GEO_FILL_SENTINELS = (-9999.9, -9999.0)
FILL_TOLERANCE = 0.05

# Climatology grid.
GRID_DEG = 0.05
GRID_LAT_MIN = -90.0
GRID_LON_MIN = -180.0
LAT_CLIP = {"GPM": (-68.0, 68.0), "TRMM": (-38.0, 38.0)}
SHARED_LAT_CLIP = (-68.0, 68.0)

# Class edges, left-closed; the slot after the last class is "undefined".
SIZE_EDGES_KM = (20.0, 50.0, 100.0)
ECHOTOP_EDGES_KM = (5.0, 7.5, 12.0)
UNDEFINED_CLASS = 4
SIZE_LABELS = ("<20", "20-50", "50-100", ">100", "undefined")
ECHOTOP_LABELS = ("<5", "5-7.5", "7.5-12", ">12", "undefined")
RAINTYPE_LABELS = ("stratiform", "convective", "other")
BREAKDOWNS = {"size": SIZE_LABELS, "echotop": ECHOTOP_LABELS, "raintype": RAINTYPE_LABELS}

# Echo-top quality control.
INNER_RAY_LO, INNER_RAY_HI = 8, 42
TOP_FLOOR_M = 15000.0
NEIGHBOUR_TOP_M = 15000.0
OBS_CEILING_M = {"GPM": 19000.0, "TRMM": 18000.0}
OBS_CEILING_DEFAULT_M = 18000.0
MAX_PEEL = 3
CENSOR_BIN_TOL = 1
ECHO_THRESHOLDS = (20, 30, 40)
FLAG_TRUNCATED = 1 << 0
FLAG_DD_FROM_TOP = 1 << 1
FLAG_ISOLATED = 1 << 2
FLAG_MIRROR = 1 << 3
FLAG_SIDELOBE = 1 << 4
FLAG_PEELED = 1 << 5
FLAG_OVERSHOOT = 1 << 6
FLAG_CENSORED = 1 << 7

# Heavy-rain occurrence thresholds, mm/h.
RAIN_THRESHOLDS = (25, 50, 75, 100)

# Plausibility limits applied when sparse grids are summed.
SANE_COUNT = 100_000_000
SANE_SUM = 1e15

# Annual maps.
MIN_VIEWS = 10
MIN_SAMPLES = 10
HOURS_PER_YEAR = 8766.0

# Reanalysis.
ENV_DEG = 0.25
GRAVITY = 9.81
SHEAR_HEIGHTS_M = (1000, 3000, 6000)
LEVEL_RANGE_HPA = (400.0, 1000.0)
ENV_VARS = ("cape", "cin", "sst", "skt", "tpr", "shear_1000m", "shear_3000m", "shear_6000m")
# Box label -> half width in grid steps.
ENV_BOXES = {"5deg": 10, "2p50deg": 5, "1p25deg": 3}
ENV_STATS = ("min", "max", "mean", "std", "p10", "p25", "p50", "p75", "p90", "p95")
ENV_PERCENTILES = (10, 25, 50, 75, 90, 95)

# Region boxes: (lat_min, lat_max, lon_min, lon_max), inclusive.
REGIONS = {
    "Amazon": (-15, 5, -75, -50),
    "Congo": (-10, 10, 10, 35),
    "Maritime Cont.": (-10, 10, 95, 150),
    "W Pacific pool": (0, 15, 130, 170),
    "E Pacific ITCZ": (2, 12, -140, -90),
    "Sahel/W Africa": (5, 18, -15, 30),
    "US Great Plains": (30, 48, -105, -85),
    "SE S.America": (-38, -20, -65, -45),
    "Bay of Bengal": (5, 22, 80, 100),
}
# The environment analyses stop at 40 degrees.
REGIONS_ENV = {**REGIONS, "US Great Plains": (30, 40, -105, -85)}

# Environment-conditioned statistics.
CAPE_COL = "p90_cape_2p50deg"
SHEAR_COL = "shear_6000m_centroid"
CIN_COL = "mean_cin_2p50deg"
CAPE_WIDTH, CAPE_MAX = 250.0, 5000.0
SHEAR_WIDTH, SHEAR_MAX = 2.0, 30.0
MIN_BIN_N = 50
PREDICTORS = (
    "p90_cape_2p50deg",
    "mean_cin_2p50deg",
    "mean_tpr_2p50deg",
    "mean_skt_2p50deg",
    "shear_1000m_centroid",
    "shear_3000m_centroid",
    "shear_6000m_centroid",
    "abs_lat",
)

METRIC_COLS = (
    "et20_sum", "et20_n", "et30_sum", "et30_n", "et40_sum", "et40_n",
    "cnt_gt25", "cnt_gt50", "cnt_gt75", "cnt_gt100",
    "eps_conv_sum", "eps_conv_n", "eps_strat_sum", "eps_strat_n",
    "nw_conv_sum", "nw_conv_n", "nw_strat_sum", "nw_strat_n",
    "dm_conv_sum", "dm_conv_n", "dm_strat_sum", "dm_strat_n",
)
