"""Constants of the ranking engine."""

# Fixed values of the data contract: thresholds, weights and limits that results depend on.
PRIOR_RATINGS = 50.0
TAG_RELEVANCE, TAGS_PER_ITEM = 0.5, 15
HOLDOUT, LIKED = 0.2, 4.0
COHORT_LIMIT, CUTOFFS = 5000, (10, 25)
WEIGHTS = {"semantic": 0.45, "behavioral": 0.40, "quality": 0.15}
POOL, NEIGHBOURS, PAGE, PAGE_MOST = 200, 10, 20, 100
POPULAR, SHARD_ROWS, BUCKETS = 1000, 512, 16
ALS_RANK, ALS_ITERATIONS, ALS_REG, SEED = 64, 10, 0.08, 42
GATE_TOLERANCE = 1e-9
SAMPLE_FRACTION = 0.01
TEXT_DIMS = 384
