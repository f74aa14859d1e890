"""idloom: identity and event analytics as DataFrame -> DataFrame operators on Spark SQL."""

__version__ = "0.1.0"
