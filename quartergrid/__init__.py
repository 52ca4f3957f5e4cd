"""Quarter-hour market time series on Spark: plain DataFrame in, DataFrame out."""
