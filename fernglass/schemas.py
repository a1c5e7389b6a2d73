"""Schemas of the records that files and indexes hold."""

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, MapType, StringType, StructField, StructType

_S, _I = StringType(), IntegerType()


def _record(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


SPAN = _record(("start", _I), ("end", _I))
PASSAGE = _record(("passage_id", _S), ("title", _S), ("text", _S), ("sentence_spans", ArrayType(SPAN)), ("source", _S))
QUESTION = _record(
    ("question_id", _S),
    ("text", _S),
    ("answer", _S),
    ("supporting_passage_ids", ArrayType(_S)),
    ("supporting_sentences", ArrayType(_record(("passage_id", _S), ("sentence_index", _I)))),
    ("level", _S),
    ("qtype", _S),
)
SOURCE_ROW = _record(
    ("id", _S),
    ("question", _S),
    ("answer", _S),
    ("level", _S),
    ("type", _S),
    ("context", _record(("title", ArrayType(_S)), ("sentences", ArrayType(ArrayType(_S))))),
    ("supporting_facts", _record(("title", ArrayType(_S)), ("sent_id", ArrayType(_I)))),
)
LABELED_QUERY = _record(("query_id", _S), ("text", _S), ("category", _S), ("relevant", MapType(_S, _I)), ("origin", _S), ("source_question_id", _S))
REVIEW = _record(
    ("query_id", _S),
    ("source_passage_id", _S),
    ("draft_text", _S),
    ("final_text", _S),
    ("reviewer", _S),
    ("reviewed_at", _S),
    ("disposition", _S),
    ("reason", _S),
    ("overlap_override", _record(("reviewer", _S), ("overridden_at", _S), ("reason", _S), ("shared_terms", ArrayType(_S)))),
)
RAW_TRIPLE = _record(("subject_text", _S), ("relation", _S), ("object_text", _S), ("sentence_index", _I), ("pattern", _S))
TRIPLE = _record(("subject", _S), ("relation", _S), ("object", _S), ("passage_id", _S), ("sentence_index", _I), ("subject_type", _S), ("object_type", _S), ("pattern", _S))
GOLD_TRIPLE = _record(("passage_id", _S), ("sentence_index", _I), ("subject", _S), ("relation", _S), ("object", _S))
ENTITY = _record(("passage_id", _S), ("sentence_index", _I), ("text", _S), ("label", _S), ("start", _I), ("end", _I))
TOKEN = _record(("passage_id", _S), ("sentence_index", _I), ("i", _I), ("text", _S), ("lemma", _S), ("pos", _S), ("tag", _S), ("dep", _S), ("head_i", _I))
HIT = _record(("query_id", _S), ("passage_id", _S), ("score", DoubleType()), ("rank", _I), ("provenance", MapType(_S, DoubleType())))
VECTOR = _record(("passage_id", _S), ("embedding", ArrayType(FloatType())))
PAIR = _record(("guid", _S), ("query", _S), ("passage", _S), ("label", _I))
