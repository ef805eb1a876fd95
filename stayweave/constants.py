"""Values that define the results. They are inputs of the analysis, not tuning knobs."""

# Bounding boxes as (lon min, lat min, lon max, lat max).
COUNTRY_BOX = (11.0273686052, 55.3617373725, 23.9033785336, 69.1062472602)
CITY_BOX = (17.6799476147, 59.1174841345, 18.4572303295, 59.475092515)

# Local time zone of the study area.
LOCAL_TZ = "Europe/Stockholm"

# Coordinate validity limits, degrees.
MIN_LATITUDE, MAX_LATITUDE, MAX_LONGITUDE = -80, 84, 180

# Stay detection (metres, minutes, hours, points).
STAY_RADIUS_M = 30
PLACE_RADIUS_M = 30
MIN_STAY_MINUTES = 15
MAX_GAP_HOURS = 3
MIN_STAY_POINTS = 2

# Stay length kept, minutes, [low, high).
STAY_MINUTES = (15, 720)

# A device is kept with more than this many places, records and days.
DEVICE_PLACES, DEVICE_RECORDS, DEVICE_DAYS = 2, 3, 7

# Home detection.
NIGHT_START_HOUR, NIGHT_END_HOUR = 22, 7
TICK_MINUTES = 15
MIN_HOME_DAYS = 3

# Place linkage (metres, count).
POI_RADIUS_M = 300
POI_NEAREST = 10
BUILDING_BUFFER_M = 50
HEX_EDGE_M = 531.414

# Population shares of the concentration index.
SHARE_NATIVE, SHARE_OTHER = 0.8044, 0.1107
SHARE_NATIVE_FULL, SHARE_OTHER_FULL = 0.8044332515556147, 0.11067529894925136
SHARE_LOW_INCOME, SHARE_HIGH_INCOME = 0.25, 0.25
MIN_VISITORS = 5

# Index groups, upper bounds of the first two.
ICE_GROUP_BOUNDS = (-0.2, 0.2)

# Hours that start the morning, the afternoon and the evening.
MORNING_HOUR, AFTERNOON_HOUR, EVENING_HOUR = 5, 12, 18

# Category filter, weight trimming, normalised edge repeats.
CATEGORY_DEVICE_SHARE = 0.01
TOP_CATEGORIES = 20
TRIM_QUANTILES = (0.05, 0.95)
KIND_REPEATS = 10

# Work labelling, two parameter sets.
WORK_PARAMS = {
    "batch": dict(home_days=28, work_days=42, min_hours=3, missing_home=0.4, missing_work=0.8,
                  share_home=0.2, share_work=0.2, days_work=0.2),
    "notebook": dict(home_days=28, work_days=42, min_hours=3, missing_home=0.7, missing_work=0.5,
                     share_home=0.7, share_work=0.4, days_work=0.6),
}

# Embedding training.
EMBEDDING_DIM = 64
CONTEXT_SIZE = 7
NEGATIVE_SAMPLES = 5

# Diagnostics.
LOW_VARIANCE = 0.001
COSINE_HIGH, COSINE_LOW, COSINE_COLLAPSED = 0.95, 0.1, 0.9
COSINE_SAMPLE = 1000
MIN_CELLS = 100
LOSS_CONVERGED = 0.9
RIDGE_SIGNAL = 0.1
