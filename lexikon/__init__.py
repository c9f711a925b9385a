"""lexikon: a Spark-native engine for text corpora, labelled datasets and
classifier evaluation.

Everything is expressed with the DataFrame API so that Catalyst plans the
work; Python workers appear only in the few operators that cannot be written
with built-in expressions (subword training steps, per-word encoders).
"""

from lexikon.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
