"""Constants and row types of the corpus, the graph and the personal state."""

from __future__ import annotations

from pyspark.sql import types as T

# Contexts of the graph; "" is the aggregate of all.
BASELINE = "citation"
ENTITY_CONTEXTS = ("author", "topic", "venue", "institution")
CONTEXTS = (BASELINE, *ENTITY_CONTEXTS)
PAPER_RELATIONS = ("cites", "cited_by", "couples", "co_cited")

# Weight of each relation.
RELATION_WEIGHTS = {
    "cites": 1.00,
    "cited_by": 0.15,
    "authored_by": 0.60,
    "wrote": 0.60,
    "couples": 0.35,
    "co_cited": 0.30,
    "published_in": 0.15,
    "publishes": 0.15,
    "tagged": 0.20,
    "tags": 0.20,
    "affiliated": 0.10,
    "hosts": 0.10,
    "trusts": 1.00,
}

# Weight of a trust strength, and of distrust.
STRENGTHS = {1: 0.2, 2: 0.45, 3: 0.7, 4: 1.0, 5: 1.4}
DISTRUST = -1.0

# Ageing, scoring, resampling and search parameters.
HALF_LIFE, REFERENCE_YEAR, LEAST_AGE_FACTOR = 60.0, 2026, 0.4
ALPHA, STEPS = 0.85, 5
HUB_CAP, LEAST_SHARED, NEIGHBOURS = 200, 3, 15
MOST_REPLICATES, COLD_START = 12, 5
RRF_K, SEARCH_LIMIT = 60, 500
MOST_POOL = 12_000
LIFT_EPSILON, LIFT_GAMMA = 1e-9, 0.5
UNREACHED = 99
DISCLAIMER = "Scores are estimates of closeness to the papers you trust, not of quality."

WORKS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("cited_by_count", T.LongType()),
        T.StructField("doi", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("is_oa", T.BooleanType()),
        T.StructField("is_stub", T.BooleanType()),
        T.StructField("venue_id", T.StringType()),
    ]
)
EDGES = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("context", T.StringType()), T.StructField("relation", T.StringType())])
TRUST = T.StructType([T.StructField("work_id", T.StringType()), T.StructField("strength", T.IntegerType()), T.StructField("is_distrust", T.BooleanType())])
