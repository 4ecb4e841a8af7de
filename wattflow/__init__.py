"""wattflow: metered-usage analytics on Spark.

Invoices are joined to daily weather by nearest station and date interval,
reduced to one feature row per invoice, extended with per-account window
features, and fed to pyspark.ml forecasts, error tables and load-curve
clustering.  Feature plans are lazy; actions happen at the sink, for bounded samples and
centroids, and inside model fits.
"""

__all__ = ["session"]
