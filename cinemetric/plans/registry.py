"""All registered queries: ``name -> (spark_fn, duckdb_sql | None)``."""

from __future__ import annotations

from . import (catalog_batches, catalog_files, catalog_frames, catalog_index, catalog_io, catalog_models, catalog_predictor,
               catalog_stream, catalog_tables, catalog_vectors)

CATALOGS = [catalog_predictor, catalog_index, catalog_vectors, catalog_frames, catalog_batches, catalog_models,
            catalog_io, catalog_files, catalog_stream, catalog_tables]


def registry() -> dict:
    out: dict = {}
    for cat in CATALOGS:
        for name, entry in cat.QUERIES.items():
            if name in out:
                raise ValueError(f"duplicate query name {name}")
            out[name] = entry
    return out
