"""Operators of a training-data pipeline: scoring, filtering, extraction, deduplication, tokenising, packing."""

import os

# Tasks and the driver share their machine's cores: one BLAS thread each, where nothing else is asked for.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
