"""shelfline: a Spark-native product catalog engine.

Turns tables of fetched pages, sitemaps, robots files and commerce API
responses into a validated product catalog, with DataFrame-in /
DataFrame-out operators built from Catalyst expressions.
"""

__version__ = "0.1.0"
