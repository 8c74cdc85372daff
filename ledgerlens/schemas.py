"""Explicit schemas; nothing is ever inferred."""

from pyspark.sql import types as T

TXN = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("txn_date", T.TimestampNTZType(), False),
    T.StructField("amount", T.DecimalType(12, 2), False),
    T.StructField("currency", T.StringType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("sub_category", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("bank_name", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("created_at", T.TimestampNTZType()),
])

MERCHANT_MAPPING = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("raw_pattern", T.StringType(), False),
    T.StructField("clean_name", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("sub_category", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

MAPPING_CSV = T.StructType([
    T.StructField("raw_pattern", T.StringType()),
    T.StructField("clean_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("sub_category", T.StringType()),
    T.StructField("priority", T.StringType()),
])

_HEADER = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
_BODY = T.StructType([T.StructField("data", T.StringType())])
_PART = T.StructType([T.StructField("mimeType", T.StringType()), T.StructField("body", _BODY)])

RAW_PAYLOAD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("internalDate", T.LongType()),
    T.StructField("labelIds", T.ArrayType(T.StringType())),
    T.StructField("payload", T.StructType([
        T.StructField("headers", T.ArrayType(_HEADER)),
        T.StructField("parts", T.ArrayType(_PART)),
        T.StructField("body", _BODY),
    ])),
])

RAW_MESSAGE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("bank_name", T.StringType()),
])

STATEMENT_TABLE = T.StructType([
    T.StructField("doc", T.StringType()),
    T.StructField("table_no", T.IntegerType()),
    T.StructField("row_no", T.LongType()),
    T.StructField("cells", T.ArrayType(T.StringType())),
])

STATEMENT_TEXT = T.StructType([
    T.StructField("doc", T.StringType()),
    T.StructField("page_no", T.LongType()),
    T.StructField("text", T.StringType()),
])

PARSED_TXN = T.StructType([
    T.StructField("txn_date", T.TimestampNTZType()),
    T.StructField("amount", T.DecimalType(12, 2)),
    T.StructField("merchant", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("bank_name", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("txn_type", T.StringType()),
])

QUESTION = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("text", T.StringType()),
])

BUDGET = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("monthly_limit", T.DecimalType(12, 2)),
    T.StructField("currency", T.StringType()),
])
