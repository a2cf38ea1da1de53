"""tabula: Spark-native tabular classification analytics.

Cleaning, leak-free preprocessing, fold assignment, distributed learners,
weighted / stacked ensembles, exhaustive ensemble-subset scoring and
leaderboards, all expressed as DataFrame / SQL / Spark ML jobs.
"""

__version__ = "0.1.0"
