"""A Spark-native engine for collections of embedded documents."""

from .collection import Collection, GetResult, HealthResult, QueryResult, ReembedReport
from .database import Database, connect
from .errors import (
    CollectionNotFoundError,
    CorruptedMetadataError,
    DimensionMismatchError,
    EmbedderIdentityMismatchError,
    EmbedderMismatchError,
    EmbedderRequiredError,
    UnsupportedFilterError,
    VectrillError,
    WriteConflictError,
)
from .functions.vectors import l2_normalize
from .operators.filters import compile_filters, compile_where, compile_where_document
from .operators.search import candidate_pairs, knn, knn_join, recall_at_k

__version__ = "0.1.0"

__all__ = [
    "Collection", "CollectionNotFoundError", "CorruptedMetadataError", "Database", "DimensionMismatchError", "EmbedderIdentityMismatchError",
    "EmbedderMismatchError", "EmbedderRequiredError", "GetResult", "HealthResult", "QueryResult", "ReembedReport", "UnsupportedFilterError",
    "VectrillError", "WriteConflictError", "candidate_pairs", "compile_filters", "compile_where", "compile_where_document", "connect", "knn",
    "knn_join", "l2_normalize", "recall_at_k",
]
