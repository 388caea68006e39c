"""stationfill: Spark jobs for curating hourly station series."""
