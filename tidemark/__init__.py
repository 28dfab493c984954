"""tidemark: order-aware analytics on Spark.

Batch and streaming operators for ordered event data: cleaning, calendar and
geographic features, leakage-free target encoders, test-then-train evaluation,
drift detection and model promotion, expressed as DataFrame / Spark ML /
Structured Streaming jobs.
"""

__version__ = "0.1.0"
