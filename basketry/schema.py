"""Column types of the inputs and outputs; files are never read with inferred types."""

from pyspark.sql import types as T

TEST_LINES = T.StructType(
    [
        T.StructField("visit_number", T.LongType()),
        T.StructField("weekday", T.StringType()),
        T.StructField("upc", T.LongType()),
        T.StructField("scan_count", T.IntegerType()),
        T.StructField("department_description", T.StringType()),
        T.StructField("fineline_number", T.LongType()),
    ]
)

TRAIN_LINES = T.StructType([T.StructField("trip_type", T.IntegerType()), *TEST_LINES.fields])

PREDICTIONS = T.StructType(
    [
        T.StructField("visit_number", T.LongType()),
        T.StructField("trip_type", T.IntegerType()),
        T.StructField("model_index", T.IntegerType()),
        T.StructField("p", T.DoubleType()),
    ]
)
