"""sigclass — labelled multichannel sensor packets on Spark.

Ingest packet streams, train per-session classifiers, evaluate them for all
sessions in one query, and classify unlabelled packets with each user's
current models. Everything is expressed with the DataFrame / Structured
Streaming APIs; see README.md for the module map.
"""

__version__ = "0.1.0"
