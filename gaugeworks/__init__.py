"""DataFrame operators for incident, reading and grant records, built on Spark SQL."""
