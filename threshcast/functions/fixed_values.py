"""Fixed values. They must equal the published data model for results to agree."""

# Columns of the observation table, in file order.
OBSERVATION_COLUMNS = [
    "DateTime", "SITE_NAME", "Harbour", "Enterococci", "3H", "6H", "12H", "24H", "48H", "72H",
    "Season", "tidal_state", "Shallowness", "Soil_type", "Catchment_slope",
    "Landcover_catchment", "watercraft_use", "sewage_discharge_beach",
    "high_intensity_agri_beach", "rain_intensity_48h", "rain_duration_48h", "wind_speed_12h",
    "wind_speed_6h", "wind_speed_3h", "hours_to_high_tide", "high_tide_height",
    "wind_direction_3h", "wind_direction_6h", "wind_direction_12h", "beach_orientation_angle",
    "Latitude", "Longitude",
]

# The text columns among them; all others are numbers.
OBSERVATION_TEXT_COLUMNS = [
    "DateTime", "SITE_NAME", "Harbour", "Season", "tidal_state", "Shallowness", "Soil_type",
    "Landcover_catchment", "watercraft_use", "sewage_discharge_beach",
    "high_intensity_agri_beach",
]

# Columns treated as categories whenever they are present.
CATEGORY_COLUMNS = [
    "SITE_NAME", "WEEK", "DAY_OF_WEEK", "MONTH", "YEAR", "Season", "Harbour", "tidal_state",
    "Shallowness", "Soil_type", "Landcover_catchment", "watercraft_use",
    "high_intensity_agri_beach", "potential_animal_contamination", "stormwater_outlet_beach",
    "sewage_discharge_beach", "Timing", "WEEKEND", "Landcover_site", "ENSO", "TIME_OF_DAY",
    "wind_shore_3h", "wind_shore_6h", "wind_shore_12h",
]

# Static attributes of a site.
SITE_COLUMNS = [
    "SITE_NAME", "Harbour", "Latitude", "Longitude", "Shallowness", "Soil_type",
    "Catchment_slope", "Landcover_catchment", "watercraft_use", "sewage_discharge_beach",
    "high_intensity_agri_beach", "beach_orientation_angle",
]

# Columns left out of the per-time features besides the site attributes.
NOT_TEMPORAL_COLUMNS = [
    "tidal_state", "wind_shore_3h", "wind_shore_6h", "wind_shore_12h", "wind_direction_3h",
    "wind_direction_6h", "wind_direction_12h", "wind_speed_3h", "wind_speed_6h",
    "wind_speed_12h",
]

# Wind windows, in hours.
WIND_WINDOWS = ["3h", "6h", "12h", "24h"]

# Holiday ranges as (name, first day, last day), month-day.
HOLIDAYS = [
    ("New Year's Day", "01-01", "01-06"),
    ("Waitangi Day", "01-31", "02-10"),
    ("Good Friday", "04-14", "04-22"),
    ("Easter Monday", "04-17", "04-25"),
    ("Anzac Day", "04-20", "04-30"),
    ("Queen's Birthday", "05-29", "06-05"),
    ("Labour Day", "10-23", "10-30"),
    ("Christmas Day", "12-20", "12-30"),
    ("Boxing Day", "12-21", "12-31"),
]

# Out-of-time test periods, half open.
TEST_PERIODS = [
    "2021-10-01_2022-10-01",
    "2022-10-01_2023-10-01",
    "2023-10-01_2024-10-01",
]

# Sites never scored in a test period.
UNTESTED_SITES = [
    "Scarborough Beach by clock tower",
    "Sumner Beach Surf club",
    "Caroline Bay - mid beach",
    "Timaru Coast Caroline Bay at Virtue Avenue",
    "Timaru Coast at yacht club jetty",
    "Taylors Mistake Beach Surf club",
]

# Thresholds, limits and levels.
EXCEEDANCE = 280.0
PRECAUTION = 140.0
TARGET_MAXIMUM = 10000.0
FORECAST_MINIMUM = 5.0
CHART_MAXIMUM = 1000.0
QUANTILE_LEVELS = [0.05, 0.30, 0.50, 0.70, 0.80, 0.90, 0.92, 0.95, 0.98]

# Text markers for a missing value and the label missing text is encoded as.
NULL_MARKERS = ["NA", "?"]
MISSING_LABEL = "nan"

# Tuned settings of the meta-learner.
META_ROUNDS = 180
META_RATE = 0.08721057029770096
META_FEATURE_SHARE = 0.9587602766121369
META_LEAVES = 40
META_L2 = 0.6540961177848345

# Settings of the quantile ensemble besides those of boosting.
PINBALL_LEAF = 10
PINBALL_L2 = 0.45

# Names of searched parameters, and the settings they stand for.
SEARCH_NAMES = {
    "n_estimators": "rounds", "learning_rate": "rate", "num_leaves": "leaves",
    "min_data_in_leaf": "min_leaf", "colsample_bytree": "feature_share", "reg_lambda": "l2",
    "maxIter": "rounds", "stepSize": "rate", "maxDepth": "max_depth",
    "minInstancesPerNode": "min_leaf", "subsamplingRate": "row_share",
}

# Settings of the linear and tree baselines and of boosting.
BASELINE_ALPHA = 0.1
BASELINE_L1_RATIO = 0.5
BASELINE_DEPTH = 8
BASELINE_LEAF = 40
BOOST_ROUNDS = 100
BOOST_RATE = 0.05
