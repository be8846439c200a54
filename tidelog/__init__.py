"""tidelog: analytics over versioned key-value changelogs on Spark."""

__version__ = "0.1.0"
