"""Default parameters and fixed vocabularies.

Everything here is an ordinary keyword-argument default; nothing reads the
environment or the clock.
"""

from __future__ import annotations

# They decide results, so they are stated plainly.
START_YEAR = 1980
LANGUAGE = "en"
MIN_BUDGET = 100_000
MIN_VOTES = 10
SAMPLE_CAP = 10_000
MAX_DISCOVER_PAGES = 500
CAST_TOP_N = 1
MISSING_ORDER = 10_000
DIRECTOR_JOB = "Director"
CREW_JOBS = ("Director", "Producer")
HIT_ROI = 3.0
FLOP_ROI = 0.0
LEADERBOARD_SIZE = 15
MIN_GROUP_ROWS = 3
SCATTER_ROWS = 6_000
TOP_VALUES_LIMIT = 400
MAX_ERRORS = 50
ID_BUCKET_WIDTH = 1_000
UNKNOWN = "Unknown"
TOP_GENRES = 15
SEED = 42
FOLDS = 5
TEST_FRACTION = 0.2
VALIDATION_FRACTION = 0.15
MIN_TRAINING_ROWS = 20

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun",
          "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

MOVIE_COLUMNS = (
    "id", "title", "original_title", "release_date", "release_year",
    "release_month", "budget", "revenue", "runtime", "vote_average",
    "vote_count", "popularity", "original_language", "adult", "genres",
    "production_companies",
)

GOLD_COLUMNS = (
    "movie_id", "title", "original_title", "release_year", "release_month",
    "budget", "budget_musd", "revenue", "revenue_musd", "roi", "runtime",
    "vote_average", "vote_count", "popularity", "genres",
    "production_companies", "lead_production_company", "director_id",
    "director_name", "lead_cast_id", "lead_cast_name",
)

ANALYTICS_COLUMNS = (
    "release_year", "vote_count", "genres", "roi", "director_name",
    "budget_musd", "revenue_musd", "vote_average", "title", "release_month",
    "lead_production_company",
)

DESCRIBED_COLUMNS = ("budget_musd", "revenue_musd", "roi", "vote_average", "vote_count")

LAYERS = ("Bronze / discover", "Bronze / movies", "Silver / movies",
          "Silver / cast", "Silver / crew", "Gold / gold_movies")
