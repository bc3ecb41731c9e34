"""Record envelope, closed vocabularies and constants, in one place."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values.
KINDS = ("node", "edge", "decision", "retraction", "tombstone", "retrieval", "merge")
NOT_LIVE = ("retraction", "tombstone", "merge")
EDGE_TYPES = ("CAUSED", "INFLUENCED", "PRECEDENT_FOR")
LEXICAL_FLOOR = 0.3
STRUCTURAL_FLOOR = 1.0
RRF_K = 60
RESULT_LIMIT = 10
CHAIN_DEPTH = 5
MAX_CHAIN_DEPTH = 20
BANDS = ((1, "direct"), (3, "near"), (6, "mid-range"))
TOKEN_PREFIX = 4
MIN_TOKEN_LENGTH = 3
WEIGHT_NAME, WEIGHT_TYPE, WEIGHT_PROPS = 0.7, 0.2, 0.1
SUGGEST_MIN_SCORE = 0.7
LINK_WEAK_MARGIN = 0.1
FALSE_SERVE_PENALTY, FALSE_ABSTAIN_PENALTY = 0.02, 0.01
PURGE_SCOPE = "this-store-only"

SPAN = T.StructType([T.StructField("source", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

#: One row of the log.  ``content`` and ``meta`` are canonical JSON, because digests are over their exact form.
RECORD = T.StructType(
    [
        T.StructField("workspace", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("prev", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("content_digest", T.StringType()),
        T.StructField("salt", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("meta", T.StringType()),
    ]
)
