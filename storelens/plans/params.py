"""Parameters of the registered queries (dashboard defaults and batch sizes)."""

# Filter selection used by the filter / export queries.
FILTER_YEARS = [1996, 1998, 2000]
FILTER_REGIONS = ["AMERICA", "ASIA", "EUROPE"]
FILTER_CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO"]
FILTER_SEGMENTS = ["AUTOMOBILE", "BUILDING", "HOUSEHOLD"]
FILTER_STATES = ["NATION_1", "NATION_2", "NATION_8", "NATION_12", "NATION_17", "NATION_21", "NATION_24"]

# Sizes of the top-k views.
TREND_MONTHS = 18
TOP_STATES = 20
TOP_CUSTOMERS = 20
TOP_CUSTOMERS_TOTAL = 10
WATCHLIST = 20
ALERTS = 8
TOP_OPPORTUNITIES = 12
TOP_SCENARIO = 15
RECENT = 12
PULSE_DAYS = 14

# Planning inputs.
FORECAST_PERIODS = 4
SCENARIO_ADJUSTMENT = 0.05
SCENARIO_SWEEP = [round(-0.20 + 0.01 * i, 2) for i in range(41)]

# Models.
TEST_FRACTION = 0.2
SEED = 42
LOSS_MODEL = dict(num_trees=240, max_depth=12, min_leaf=3)
LOSS_MODEL_VARIANT = dict(num_trees=220, max_depth=10, min_leaf=1)
PROFIT_MODEL = dict(num_trees=220, max_depth=14, min_leaf=2)
