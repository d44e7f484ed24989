"""Data model: schemas, enums and defaults."""

from __future__ import annotations

import re
from enum import StrEnum

DOCUMENTS = "id long, text string, metadata string, embedding array<float>, parent_id long"
EDGES = "src_id long, dst_id long, kind string, weight double, hits long, bonus double, last_touch double, metadata string"
EVENTS = "seq long, ts double, kind string, doc_id long, payload string"
TTL = "doc_id long, expires_at double, on_expire string"
PENDING = "doc_id long, embedding array<float>, source string, enqueued_at double"
CLUSTERS = "name string, algorithm string, n_clusters int, centroids array<array<float>>, created_at double, metadata string"
POSTINGS = "term string, id long, stamp long, positions array<int>"
LENGTHS = "id long, stamp long, n_tokens int"
CELLS = "cell int, id long, embedding array<float>"
FRESH = "id long, embedding array<float>"
TABLES = {"documents": DOCUMENTS, "edges": EDGES, "events": EVENTS, "ttl": TTL, "pending": PENDING, "clusters": CLUSTERS, "postings": POSTINGS, "lengths": LENGTHS, "cells": CELLS, "fresh": FRESH}
#: Tables whose rows can be replaced and dropped by key.
KEYS = {"documents": ("id",), "edges": ("src_id", "dst_id", "kind"), "ttl": ("doc_id",), "pending": ("doc_id",), "clusters": ("name",), "lengths": ("id",), "fresh": ("id",)}

COLLECTION_NAME = re.compile(r"[a-zA-Z0-9_]+")
#: Fixed defaults of the data model.
K = 5
RRF_K = 60
FETCH_K = 20
CROSS_K = 10
LAMBDA_MULT = 0.5
BRUTE_FORCE_LIMIT = 10_000
DEPTH_CAP = 100
SILHOUETTE_SAMPLE = 10_000
SWEEP_LIMIT = 1000
FILTER_LIST_MAX = 999
REBUILD_FLUSHES, REBUILD_TOMBSTONES, REBUILD_SECONDS = 5000, 5000, 3600.0


class Distance(StrEnum):
    COSINE = "cosine"
    L2 = "l2"
    HAMMING = "hamming"


class Quantization(StrEnum):
    FLOAT = "float"
    FLOAT16 = "float16"
    INT8 = "int8"
    BIT = "bit"
