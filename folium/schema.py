"""Names, kinds and types of the ledger's tables."""

from pyspark.sql import types as T

# Kinds of blocks, and those that are kept word for word.
KINDS = ("paragraph", "metadata", "footnote", "heading", "caption", "figure", "table", "formula", "reference", "code", "page", "excluded", "unclassified")
VERBATIM = ("figure", "formula", "code", "page", "excluded")
STAGES = ("structure", "terms", "translate", "review", "full_review", "complete")

SPAN = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])
SPANS = T.ArrayType(SPAN)
PAIR = T.StructType([T.StructField("id", T.StringType()), T.StructField("source", SPANS), T.StructField("target", SPANS)])
LOCATION = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("paragraph_index", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
    ]
)
#: What every importer gives for each fragment of a document: an atom and its block in one row.
FRAGMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("atom_id", T.StringType()),
        T.StructField("block_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("location", LOCATION),
    ]
)
ISSUE = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("issue_id", T.StringType()), T.StructField("message", T.StringType())])
