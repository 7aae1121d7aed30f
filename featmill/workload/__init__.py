"""One registered query per operator, each with the SQL that computes the same result."""

from featmill.workload import jobs, mixing, plans, positions, scores, shards, tensors  # noqa: F401
from featmill.workload.base import QUERIES, SQL  # noqa: F401
