"""deserta — Spark-native analytics for finding under-served areas.

Layout:
  sources/    table scans, sinks, GeoJSON, and the test-data fixture mappings
  functions/  Column-expression builders (cleaning, risk, geo, planning, capability)
  operators/  DataFrame -> DataFrame operators (distance join, kNN, polygon join, aggregates, audits)
  plans/      composed pipelines (indicators, distances, capability, serving, planning, console, legacy)
  streaming/  incremental refresh of the indicator table over a file stream
"""

__version__ = "0.1.0"
