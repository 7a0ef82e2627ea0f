"""Table and message schemas, and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the application's, in this order).
# Label domain in its fixed order; the index of a label in this list is the
# class number used by the metric report legend (Shallow 0.0, Medium 1.0,
# Deep 2.0).
LABELS = ["Shallow", "Medium", "Deep"]
# Placeholder stored for a model that does not exist yet for the user.
PLACEHOLDER = "Generating Model"
# Keys of the prediction map, one per model type.
MAP_KEYS = {"rf": "RandomForest", "mlp": "MLPerceptron", "nb": "NaiveBayes"}
MODEL_TYPES = ["rf", "mlp", "nb"]
# Channels per packet (the perceptron's input layer is this wide).
N_CHANNELS = 6
# A channel with at most this many distinct values in a session is categorical.
MAX_CATEGORIES = 6
# Hold-out share and the split threshold on the 0..99 bucket of md5(pk).
TRAIN_PERCENT = 60
# Classifier settings.
RF_NUM_TREES = 20
MLP_HIDDEN_LAYERS = [5, 4]
MLP_BLOCK_SIZE = 128
MLP_MAX_ITER = 100
MLP_SEED = 1234
NB_SMOOTHING = 1.0
SPLIT_SEED = 1234
# Metric names of the report, in report order.
CLASS_METRICS = ["precision", "recall", "f1", "fpr", "tpr"]
WEIGHTED_METRICS = ["weighted_precision", "weighted_recall", "weighted_f1",
                    "weighted_fpr", "weighted_tpr"]
# ---------------------------------------------------------------------------

# Session table (one row per calibration session).
CALIBRATIONS = T.StructType([
    T.StructField("calibrationid", T.StringType(), False),
    T.StructField("userid", T.StringType(), True),
    T.StructField("startdate", T.TimestampNTZType(), True),
    T.StructField("enddate", T.TimestampNTZType(), True),
    T.StructField("modelsgenerated", T.BooleanType(), True),
])

# Stored labelled packets.
CALIBRATION_PACKETS = T.StructType([
    T.StructField("pk", T.StringType(), False),
    T.StructField("date", T.TimestampNTZType(), True),
    T.StructField("eeg", T.ArrayType(T.StringType()), True),
    T.StructField("label", T.StringType(), True),
    T.StructField("userid", T.StringType(), True),
    T.StructField("calibrationid", T.StringType(), True),
    # the packet's channel vector, parsed and validated at ingest (the record's eegVector)
    T.StructField("features", T.ArrayType(T.DoubleType()), True),
])

# Stored unlabelled packets with their predictions.
INSTRUCTION_PACKETS = T.StructType([
    T.StructField("pk", T.StringType(), False),
    T.StructField("date", T.TimestampNTZType(), True),
    T.StructField("eeg", T.ArrayType(T.StringType()), True),
    T.StructField("predictedlabels", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("userid", T.StringType(), True),
    T.StructField("features", T.ArrayType(T.DoubleType()), True),
    # any entry still the placeholder; a stored boolean so the backfill filter reaches Parquet
    T.StructField("pending", T.BooleanType(), True),
])

# Unlabelled packets that wait for a model, and the version of the current models they were scored with last.
PENDING_PACKETS = T.StructType([*INSTRUCTION_PACKETS.fields, T.StructField("scored_with", T.LongType(), True)])

# JSON payloads of the two topics. Channel values arrive as strings; numbers
# are accepted too (from_json renders them as their text).
LABELLED_MESSAGE = T.StructType([
    T.StructField("DataPacketValue", T.ArrayType(T.StringType()), True),
    T.StructField("Label", T.StringType(), True),
    T.StructField("userId", T.StringType(), True),
    T.StructField("calibrationId", T.StringType(), True),
    T.StructField("_corrupt_record", T.StringType(), True),
])

UNLABELLED_MESSAGE = T.StructType([
    T.StructField("DataPacketValue", T.ArrayType(T.StringType()), True),
    T.StructField("userId", T.StringType(), True),
    T.StructField("_corrupt_record", T.StringType(), True),
])
