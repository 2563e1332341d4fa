"""Revisit: entity-history features, labels, models and scores on Spark.

Everything here is DataFrame or Spark ML code. See README.md for a tour.
"""

from revisit.schema import EventColumns

__all__ = ["EventColumns"]
