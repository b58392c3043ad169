"""seqpool: Spark-native aggregation of ragged token-embedding sets and exact rank-based evaluation.

Sub-packages
------------
sources    scans and sinks (CSV / edge lists / FASTA / annotation TSV / array blobs / feature store)
functions  column expressions (vector math, activations, tokenizers, key handling)
operators  relational operators (pooling, joins, labels, metrics, scoring, fitting)
plans      views over the driver tables, parameter generation, distributed prefix sums
streaming  incremental featurisation and running metrics with Structured Streaming
"""

__version__ = "0.1.0"
