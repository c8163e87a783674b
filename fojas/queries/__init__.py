from fojas.queries import corpus, editions, evaluation, grounding, replay, retrieval, stores  # noqa: F401
from fojas.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
