"""The catalogue of queries; importing it registers them."""

from . import aggregates, fields, pages, plots, relational, scalars, state, stores, streams, terrain, udfs, windows  # noqa: F401
