"""Reading test documents, responses and examples.

A test document is one JSON object ``{test_metadata, questions[]}``.  Documents
are read as text, checked against the rules of the document format while still
untyped (so that an absent field, a null and a value of the wrong type can be
told apart, see ``schema``), and only then given the fixed schema.  No schema is inferred.
"""

from __future__ import annotations

import json
import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.sources import schema

METADATA_TYPE = (
    "struct<test_id:string,year:int,grade_level:string,subject_areas:array<string>,"
    "total_questions:int,estimated_duration_minutes:int,created_date:string>"
)
QUESTION_FIELDS = (
    "question_id:string,question_type:string,subject_area:string,difficulty_level:int,"
    "learning_objective:string,stimulus:struct<type:string,content:string,title:string>,"
    "question_text:string,options:array<struct<option_id:string,text:string>>,"
    "correct_answer:struct<answer:string,explanation:string,acceptable_variations:array<string>>,"
    "scoring_rubric:struct<points_possible:int,"
    "scoring_criteria:array<struct<points:int,criteria:string>>>,tags:array<string>"
)
DOCUMENT_SCHEMA = f"test_metadata {METADATA_TYPE}, questions array<struct<{QUESTION_FIELDS}>>"
EXAMPLE_SCHEMA = (
    "instruction string, input string, output string, task_type string, subject_area string, "
    "difficulty_level int, question_type string"
)

#: The rules of the document format, a draft-07 schema.
FORMAT = json.loads(pkgutil.get_data("markbook.sources", "test_document.json"))  # also out of a shipped archive
_QUESTION = "#/definitions/question"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``*.json`` file of a directory: file path and raw text."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("document"))


def violations(document: str) -> Column:
    """Every rule of the document format that a JSON text column breaks, as an array."""
    return schema.violations(FORMAT, document)


def question_violations(document: str) -> Column:
    """The rules that the JSON text of one question breaks, as an array."""
    return schema.violations({"$ref": _QUESTION}, document, "question", FORMAT)


def with_violations(documents: DataFrame, document: str = "document") -> DataFrame:
    """Add ``violations`` to raw documents."""
    return documents.withColumn("violations", violations(document))


def parsed_question(document: str) -> Column:
    """The JSON text of one question as a struct; integers may be written as decimals."""
    read = F.from_json(F.col(document), f"struct<{QUESTION_FIELDS}>".replace(":int", ":double"))
    return read.try_cast(f"struct<{QUESTION_FIELDS}>")


def parse_documents(documents: DataFrame, document: str = "document") -> DataFrame:
    """Give the fixed schema to documents that break no rule; drop the others.

    ``count_matches`` tells whether the stated number of questions is right.
    """
    # An integer may be written with a decimal point: numbers are read as such, then made whole.
    read = F.from_json(F.col(document), DOCUMENT_SCHEMA.replace(":int", ":double"))
    parsed = read.try_cast(f"struct<test_metadata:{METADATA_TYPE},questions:array<struct<{QUESTION_FIELDS}>>>")
    return (
        with_violations(documents, document)
        .filter(F.size("violations") == 0)
        .withColumn("__parsed", parsed)
        .select(
            *[c for c in documents.columns if c != document],
            F.col("__parsed.test_metadata").alias("test_metadata"),
            F.col("__parsed.questions").alias("questions"),
        )
        .withColumn(
            "count_matches", F.col("test_metadata.total_questions") == F.size("questions")
        )
    )


def rejected_documents(documents: DataFrame, document: str = "document") -> DataFrame:
    """The documents that break a rule, with what they break."""
    return with_violations(documents, document).filter(F.size("violations") > 0)


def flatten_questions(tests: DataFrame, keep: tuple = ()) -> DataFrame:
    """One row per question, in order (``question_no`` from 0), metadata carried."""
    return tests.select(
        *keep,
        F.col("test_metadata.test_id").alias("test_id"),
        F.col("test_metadata"),
        F.posexplode("questions").alias("question_no", "question"),
    ).select(*keep, "test_id", "test_metadata", "question_no", "question.*")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Directory of documents to question rows; invalid documents are left out."""
    return flatten_questions(parse_documents(read_documents(spark, path)))


def read_jsonl(spark: SparkSession, path: str, schema: str = EXAMPLE_SCHEMA) -> DataFrame:
    """Newline-delimited JSON; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def is_response_map(document: str = "document") -> Column:
    """Whether a text column holds a JSON object."""
    kind = F.schema_of_variant(F.try_parse_json(document))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def rejected_responses(files: DataFrame, document: str = "document") -> DataFrame:
    """The response files that cannot be read."""
    return files.filter(~is_response_map(document))


def explode_responses(files: DataFrame, document: str = "document") -> DataFrame:
    """Response maps ``{question_id: text}`` to rows; the other columns are carried.

    A map without an answer gives no row (``sittings_of`` has its student); text that
    is no JSON object is an error: leave out what ``rejected_responses`` finds first.
    """
    unreadable = F.raise_error(F.concat(F.lit("not a response map: "), F.substring(F.coalesce(document, F.lit("null")), 1, 200)))
    answers = F.when(is_response_map(document), F.from_json(F.col(document), "map<string,string>")).otherwise(
        unreadable
    )
    return files.select(
        *[c for c in files.columns if c != document],
        F.explode(answers).alias("question_id", "response"),
    )


def read_response_files(spark: SparkSession, path: str, test_id: str) -> DataFrame:
    """Directory of response files, one student each, named after the student."""
    return read_documents(spark, path).withColumns(
        {
            "student_id": F.regexp_extract("file", r"([^/]+)\.json$", 1),
            "test_id": F.lit(test_id),
        }
    )


def sittings_of(files: DataFrame) -> DataFrame:
    """Who sat which test: every response file, also one without an answer."""
    return files.select("student_id", "test_id").distinct()


def read_responses(spark: SparkSession, path: str, test_id: str) -> DataFrame:
    """The answers in a directory of response files; a file that cannot be read is an error."""
    return explode_responses(read_response_files(spark, path, test_id).drop("file"))
