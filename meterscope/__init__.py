"""meterscope: analytics over fleets of cumulative utility counters, as Spark DataFrame operators."""
