"""One JSON document per test, ``{test_id}.json``, however many questions a test has.

A document is written line by line, so it is JSON as a whole and its lines can be read apart::

    {"test_metadata":{...},"questions":[
    {"question_id":...}
    ,{"question_id":...}
    ]}

Rows are turned into JSON by Spark and sorted by test and question number over all tasks.
Each task streams its rows into files and never holds a test.  A test that lies in one
task is a finished file; the first and the last test of a task may go on in the next one
and are written as pieces, which a second job puts together, one task per such test, by
copying bytes.  Everything is written beside the folder and takes its name in one step at
the end, so readers see all documents or none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from markbook.plans.files import exists, file_system
from markbook.plans.joins import small
from markbook.plans.positions import numbered_lines
from markbook.sources import documents

QUESTION_COLUMNS = (
    "question_id", "question_type", "subject_area", "difficulty_level", "learning_objective",
    "stimulus", "question_text", "options", "correct_answer", "scoring_rubric", "tags",
    "generated_at", "validation_score", "validation_warnings",
)
HEAD, FOOT = '{"test_metadata":', "]}"
_HEADER, _QUESTION = 0, 1
_COPY = 1 << 22  # bytes copied at a time
PACKING = "zstd"


def file_name(test_id: str) -> str:
    """The name of a test's document; letters a file name may not have are written as %xx."""
    return f"{quote(test_id, safe=' +,=@()')}.json"


@dataclass
class Piece:
    """A part of a test that another task may have more of."""

    test_id: str
    path: str
    task: int
    packing: str | None = None
    headed: bool = False
    questions: int = 0


@dataclass
class Written(WriterCommitMessage):
    """What a task tells the driver: its first and last test, nothing of those between."""

    tests: int
    pieces: list[Piece] = field(default_factory=list)


class _Task:
    """Streams the sorted rows of one task into files."""

    def __init__(self, folder: str) -> None:
        context = TaskContext.get()
        self.number = context.partitionId() if context else 0
        attempt = context.taskAttemptId() if context else 0
        self.fs, self.folder = file_system(folder)
        self.own = f"{self.folder}/_tasks/{self.number}-{attempt}"
        self.fs.create_dir(self.own, recursive=True)
        self.out = None
        self.piece: Piece | None = None
        self.first: Piece | None = None
        self.tests = 0

    def add(self, test_id: str, kind: int, bodies: list[str]) -> None:
        if self.piece is None or self.piece.test_id != test_id:
            self.close(last=False)
            # The first test may fill the task and is copied later: it is kept compressed till then.
            packing = None if self.tests else PACKING
            name = f"{self.own}/{self.tests}-{uuid.uuid4().hex}"
            self.piece = Piece(test_id, name, self.number, packing)
            self.out = self.fs.open_output_stream(name, buffer_size=1 << 20, compression=packing)
            self.tests += 1
        if kind == _HEADER:
            if not self.piece.headed:  # of several rows of one test the first one counts
                self.out.write(f'{HEAD}{bodies[0]},"questions":[\n'.encode())
                self.piece.headed = True
            return
        comma = "" if self.piece.headed and not self.piece.questions else ","
        self.out.write(comma.encode() + "\n,".join(bodies).encode("utf-8", "surrogatepass") + b"\n")
        self.piece.questions += len(bodies)

    def close(self, last: bool) -> None:
        if self.piece is None:
            return
        edge = last or self.first is None
        if not edge:
            self.out.write(FOOT.encode())
        self.out.close()
        if self.first is None:
            self.first = self.piece
        elif not edge:
            if self.piece.headed:
                self.fs.move(self.piece.path, f"{self.folder}/{file_name(self.piece.test_id)}")
            else:  # questions of no test
                self.fs.delete_file(self.piece.path)


class TestFileWriter(DataSourceArrowWriter):
    """Writes ``test_id, kind, body`` rows, sorted, into a new folder."""

    __test__ = False

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = _Task(self.folder)
        for batch in iterator:
            tests, kinds, bodies = (batch[c].to_pylist() for c in ("test_id", "kind", "body"))
            begin = 0
            for end in range(1, len(tests) + 1):
                if end == len(tests) or tests[end] != tests[begin] or kinds[end] != kinds[begin]:
                    task.add(tests[begin], kinds[begin], bodies[begin:end])
                    begin = end
        task.close(last=True)
        edges = {id(p): p for p in (task.first, task.piece) if p is not None}
        return Written(task.tests, list(edges.values()))

    def commit(self, messages: list[Written | None]) -> None:
        if any(m is None for m in messages):
            raise RuntimeError("a task did not say what it wrote")
        fs, folder = file_system(self.folder)
        with fs.open_output_stream(f"{folder}/_pieces.json") as out:
            out.write(json.dumps([p.__dict__ for m in messages for p in m.pieces]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = file_system(self.folder)
        if exists(fs, folder):
            fs.delete_dir(folder)


class TestFileSource(DataSource):
    """The sink ``test_files``; its option ``path`` is the folder to write to."""

    __test__ = False

    @classmethod
    def name(cls) -> str:
        return "test_files"

    def schema(self) -> str:
        return "test_id string, kind int, body string"

    def writer(self, schema, overwrite: bool) -> TestFileWriter:
        return TestFileWriter(self.options["path"])


def _joined(folder: str, pieces: list[Piece]) -> bool:
    """Copy the pieces of one test, in order of their tasks, into its document."""
    if not any(p.headed for p in pieces):
        return False
    fs, base = file_system(folder)
    target = f"{base}/_tasks/{uuid.uuid4().hex}"
    with fs.open_output_stream(target, buffer_size=1 << 20) as out:
        questions = 0
        for piece in sorted(pieces, key=lambda p: p.task):
            with fs.open_input_stream(piece.path, compression=piece.packing) as source:
                if not piece.headed and not questions and piece.questions:
                    source.read(1)  # the comma before the first question
                while part := source.read(_COPY):
                    out.write(part)
            questions += piece.questions
        out.write(FOOT.encode())
    fs.move(target, f"{base}/{file_name(pieces[0].test_id)}")
    return True


def _join_pieces(spark: SparkSession, folder: str) -> None:
    """Second job: the tests at the borders of tasks, at most two per task, one task each."""
    fs, base = file_system(folder)
    with fs.open_input_stream(f"{base}/_pieces.json") as source:
        pieces = json.loads(source.read())
    tests: dict[str, list[dict]] = {}
    for piece in pieces:
        tests.setdefault(piece["test_id"], []).append(piece)
    if not tests:
        return
    rows = spark.createDataFrame([(json.dumps(p),) for p in tests.values()], "pieces string")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_joined(folder, [Piece(**p) for p in json.loads(text)]) for text in batch["pieces"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.bool_())], names=["done"])

    rows.repartition(min(len(tests), 1000)).mapInArrow(join, "done boolean").where("done").count()


def write_test_files(tests: DataFrame, questions: DataFrame, path: str) -> None:
    """Write every test of ``tests`` as ``{path}/{test_id}.json``; ``path`` is replaced.

    ``tests`` holds one row of metadata per test, ``questions`` its questions with ``test_id``
    and ``question_no``, which gives their order (nulls first, then by their JSON).  A test
    without questions has an empty list; rows without a test id and questions of tests that
    are not listed are left out; of several rows of one test the first by its JSON counts.
    """
    spark = tests.sparkSession
    spark.dataSource.register(TestFileSource)
    fields = [c for c in QUESTION_COLUMNS if c in questions.columns]
    heads = tests.select("test_id", F.lit(_HEADER).alias("kind"), F.lit(None).cast("long").alias("question_no"),
                         F.to_json(F.struct(*tests.columns)).alias("body"))
    body = F.to_json(F.struct(*fields))
    listed = questions.select("test_id", F.lit(_QUESTION).alias("kind"), F.col("question_no").cast("long"), body.alias("body"))
    rows = heads.unionByName(listed).where(F.col("test_id").isNotNull())
    fs, base = file_system(path)
    parent, _, name = base.rstrip("/").rpartition("/")
    staged = f"{parent}/_{name}-{uuid.uuid4().hex}"
    staged_uri = path.rstrip("/")[: -len(name)] + staged.rpartition("/")[2]
    fs.create_dir(staged, recursive=True)
    order = ("test_id", "kind", "question_no")
    ranged = rows.repartitionByRange(*order, F.xxhash64("body")).sortWithinPartitions(*order, "body")
    ranged.select("test_id", "kind", "body").write.format("test_files").mode("append").option("path", staged_uri).save()
    _join_pieces(spark, staged_uri)
    fs.delete_dir(f"{staged}/_tasks")
    fs.delete_file(f"{staged}/_pieces.json")
    fs.open_output_stream(f"{staged}/_SUCCESS").close()
    if exists(fs, base):
        old = f"{parent}/_{name}-{uuid.uuid4().hex}"
        fs.move(base, old)
        fs.move(staged, base)
        fs.delete_dir(old)
    else:
        fs.move(staged, base)


def read_test_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The documents ``write_test_files`` wrote, read by lines: question rows, and rejected documents.

    A document is split among tasks like any text.  Every line is checked against its part
    of the document format.  Questions carry ``test_id``, ``test_metadata``, ``question_no`` from 0 and
    ``count_matches`` (whether the stated total is right); a document of which any line breaks
    a rule is rejected as a whole and listed as ``file, line_no, violations``, those lines only.
    """
    lines = numbered_lines(spark, path, "*.json")
    is_head = F.col("value").startswith(HEAD)
    is_foot = F.col("value") == FOOT
    head = lines.where(is_head).select("file", "line_no", F.concat("value", F.lit(FOOT)).alias("document"))
    question = lines.where(~is_head & ~is_foot).select(
        "file", "line_no", F.regexp_replace("value", "^,", "").alias("document")
    )
    checked = documents.with_violations(head).unionByName(
        question.withColumn("violations", documents.question_violations("document"))
    )
    rejected = checked.where(F.size("violations") > 0).select("file", "line_no", "violations")
    bad = rejected.select("file").distinct()
    counts = question.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    tests = (
        documents.parse_documents(head.drop("line_no"))
        .select("file", "test_metadata")
        .join(bad, "file", "left_anti")
        .join(counts, "file", "left")
        .withColumn("count_matches", F.col("test_metadata.total_questions") == F.coalesce("_n", F.lit(0)))
        .drop("_n")
    )
    rows = (
        question.select("file", (F.col("line_no") - 1).alias("question_no"), documents.parsed_question("document").alias("q"))
        .join(small(tests), "file")
        .select("file", F.col("test_metadata.test_id").alias("test_id"), "test_metadata", "question_no", "count_matches", "q.*")
    )
    return rows, rejected

