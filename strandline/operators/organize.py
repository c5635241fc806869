"""Timelines sorted into categories by an outside classifier, which is a function that the caller gives.

The library never calls a network: `classify` gets a batch of messages and returns what the service said. Requests are made
from a table, one after the other; what comes back is written down at once, a file for each batch, so a run that broke off
goes on behind its last answer and no answer stays on the driver. Reading the answers is a query: JSON is taken apart
by its schema, and everything that can be wrong with an answer is a row of a table (`problems`).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import text as X
from strandline.operators.ranking import ranked
from strandline.operators.timeline import CONVERSATION_COLORS, GREY
from strandline.scratch import new_path, table

UNCATEGORIZED = "uncategorized"
#: Messages of one request.
BATCH = 500


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_S = T.StringType()
#: What an answer holds. Answers are read by it, and the service is told it.
ANSWER = _fields(title=_S, categories=T.ArrayType(_fields(id=_S, label=_S)), assignments=T.ArrayType(_fields(id=_S, category=_S, importance=T.IntegerType(), summary=_S)))
TASK = (
    "Sort these messages into a timeline. Name three to eight categories by subject or line of work, not by sender. Give each message one category, an importance from 0 (routine) to 3 (a milestone "
    "or decision) and a neutral summary of one line. Add nothing that the messages don't say."
)

# The fields of a chat service with structured output, and how it says that it ran out of room.
MOST_OUTPUT = 16_000
CUT_OFF = "max_tokens"

#: What can be wrong with an answer, in the order in which it is told.
PROBLEMS = {
    "cut": "the answer was cut off: there were too many messages for one request",
    "silent": "the response holds no text",
    "no_json": "the response's text is no JSON",
    "shape": "the answer must have the lists categories and assignments",
}


class ClassifierError(ValueError):
    """No messages, no classifier or an answer of the wrong shape."""


class Answers(NamedTuple):
    title: str | None
    #: raw (the id as given), label, ordinal: each category once, in the order of first mention.
    categories: DataFrame
    #: id, category, importance, summary, seq: by seq the last of an id counts.
    assignments: DataFrame


def json_schema(kind: T.DataType) -> dict:
    """A Spark type as a JSON schema in which every field is required."""
    match kind:
        case T.StructType():
            return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind}, "required": kind.names, "additionalProperties": False}
        case T.ArrayType():
            return {"type": "array", "items": json_schema(kind.elementType)}
        case T.IntegerType():
            return {"type": "integer"}
    return {"type": kind.typeName()}


def service(transport: Callable[[dict], dict] | None, model: str) -> Callable[[list[dict]], dict] | None:
    """A classifier over a chat service: transport sends a request's body and returns the response. None without a transport."""
    if transport is None:
        return None
    form = {"type": "json_schema", "schema": json_schema(ANSWER)}

    def classify(messages: list[dict]) -> dict:
        said = "Answer for every id of this JSON array of messages.\n\n" + json.dumps(messages, ensure_ascii=False)
        return transport(dict(model=model, max_tokens=MOST_OUTPUT, system=TASK, messages=[dict(role="user", content=said)], output_config=dict(format=form)))

    return classify


def decoded(responses: DataFrame) -> DataFrame:
    """batch, problem (a name of PROBLEMS or null), title, categories, assignments. responses: batch, body (JSON).

    A body is a service's response, whose first text is the answer, or the answer itself.
    """
    part = lambda v, path, kind: F.try_variant_get(v, path, kind)
    body = F.try_parse_json("body")
    blocks = part(F.col("v"), "$.content", "array<variant>")
    texts = F.filter(F.transform(blocks, lambda b: F.when(part(b, "$.type", "string") == "text", part(b, "$.text", "string"))), lambda t: F.coalesce(t, F.lit("")) != "")
    wrapped = part(F.col("v"), "$.content", "variant").isNotNull() | part(F.col("v"), "$.stop_reason", "variant").isNotNull()
    rows = responses.select("batch", "body", body.alias("v"))
    rows = rows.select("batch", (part(F.col("v"), "$.stop_reason", "string") == CUT_OFF).alias("cut"), F.when(wrapped, F.get(texts, F.lit(0))).otherwise(F.col("body")).alias("said"))
    rows = rows.withColumn("a", F.try_parse_json("said")).withColumn("answer", F.from_json("said", ANSWER))
    listed: Column = part(F.col("a"), "$.categories", "array<variant>").isNotNull() & part(F.col("a"), "$.assignments", "array<variant>").isNotNull()
    wrong = {"cut": F.col("cut"), "silent": F.col("said").isNull(), "no_json": F.col("a").isNull(), "shape": ~F.coalesce(listed, F.lit(False))}
    problem = F.coalesce(*[F.when(wrong[name], F.lit(name)) for name in PROBLEMS])
    return rows.select("batch", problem.alias("problem"), "answer.title", "answer.categories", "answer.assignments")


def problems(responses: DataFrame) -> DataFrame:
    """batch, problem, said: a row for each answer that can't be used."""
    said = F.create_map(*[F.lit(x) for pair in PROBLEMS.items() for x in pair])
    return decoded(responses).where("problem is not null").select("batch", "problem", said[F.col("problem")].alias("said"))


def answers(responses: DataFrame) -> Answers:
    """The answers of all batches as tables. Raises ClassifierError with the first problem, if there is one."""
    read = table(decoded(responses), "answers")
    first = read.agg(F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("batch"))).alias("problem"), F.min_by("title", F.when(F.coalesce("title", F.lit("")) != "", F.col("batch"))).alias("title")).first()
    if first.problem:
        raise ClassifierError(PROBLEMS[first.problem])
    place = F.struct("batch", "k").alias("place")
    named = read.select("batch", F.posexplode("categories").alias("k", "c")).select(place, F.col("c.id").alias("raw"), "c.label")
    named = named.groupBy(F.coalesce(F.nullif("raw", F.lit("")), "label").alias("name")).agg(F.min(F.struct("place", "raw", "label")).alias("x"))
    named = ranked(named.select("x.raw", "x.label", "x.place"), ["place"]).select("raw", "label", (F.col("ordinal") - 1).cast("int").alias("ordinal"))
    given = read.select("batch", F.posexplode("assignments").alias("k", "a")).select("a.id", F.coalesce("a.category", F.lit("")).alias("category"), F.coalesce("a.importance", F.lit(0)).alias("importance"), "a.summary", place)
    return Answers(first.title, named, given.withColumnRenamed("place", "seq"))


def parse_response(spark: SparkSession, response: dict) -> Answers:
    """One response as tables."""
    return answers(spark.createDataFrame([(0, json.dumps(response))], "batch long, body string"))


def classifier_inputs(unique: DataFrame) -> DataFrame:
    """id (e1, e2, ... by time), date, from, subject, snippet, and the message's columns."""
    rows = ranked(unique, ["ts", "first_seen"])
    return rows.select(
        F.concat(F.lit("e"), F.col("ordinal").cast("string")).alias("id"), X.iso_date(F.col("timestamp")).alias("date"), X.display_name(F.col("sender")).alias("from"), X.strip(X.text(F.col("subject"))).alias("title"),
        X.snippet(F.col("body"), 160).alias("snippet"), (F.col("ordinal") - 1).alias("pos"), *[F.col(c) for c in unique.columns if c not in ("id", "date", "from", "title", "snippet", "pos")],
    )


class Ledger:
    """The answers that were given, a file for each batch, named after the batch and what was asked."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._home)

    def _place(self, batch: int, messages: list[dict]):
        asked = hashlib.sha256(json.dumps(messages, sort_keys=True).encode()).hexdigest()[:16]
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{batch:09d}-{asked}.json")

    def ask(self, batch: int, messages: list[dict], classify: Callable[[list[dict]], dict]) -> str:
        """Ask for a batch that has no answer yet; the name of its file."""
        place = self._place(batch, messages)
        if not self._fs.exists(place):
            draft = place.suffix(".draft")
            out = self._fs.create(draft, True)
            out.write(bytearray(json.dumps(classify(messages)).encode()))
            out.close()
            self._fs.rename(draft, place)
        return str(place.getName())

    def responses(self, asked: DataFrame) -> DataFrame:
        """batch, body of the answers whose files asked (file) names."""
        files = self.spark.read.schema("value string").option("wholetext", True).option("pathGlobFilter", "*.json").text(self.path)
        files = files.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("body"))
        return files.join(asked, "file", "left_semi").select(F.substring("file", 1, 9).cast("long").alias("batch"), "body")


def classify_messages(inputs: DataFrame, classify: Callable[[list[dict]], dict] | None, batch: int = BATCH, ledger: str | None = None) -> Answers:
    """The answers for all messages. ledger: a folder where answers stay, so that what was answered isn't asked again."""
    if classify is None:
        raise ClassifierError("no classifier was given")
    spark = inputs.sparkSession
    book = Ledger(spark, ledger or new_path(spark, "ledger"))
    message = F.struct("pos", "id", "date", "from", F.col("title").alias("subject"), "snippet")
    batches = inputs.groupBy(F.floor(F.col("pos") / batch).alias("batch")).agg(F.array_sort(F.collect_list(message)).alias("messages"))
    names = []
    for r in table(batches, "requests").orderBy("batch").toLocalIterator():  # one batch at a time
        names.append((book.ask(r.batch, [{k: v for k, v in m.asDict().items() if k != "pos"} for m in r.messages], classify),))
    if not names:
        raise ClassifierError("there are no messages to classify")
    return answers(book.responses(spark.createDataFrame(names, "file string")))


def classification_frames(spark: SparkSession, answer: Answers | dict) -> tuple[DataFrame, DataFrame]:
    """(categories: id, label, color, ordinal, raw; assignments: id, category, importance, summary, seq) of answers, or of one as a dictionary."""
    if isinstance(answer, dict):
        answer = parse_response(spark, {"categories": [], "assignments": []} | answer)
    palette = F.array(*[F.lit(c) for c in CONVERSATION_COLORS])
    own = F.coalesce(F.nullif("raw", F.lit("")), X.slug(F.coalesce("label", F.lit("category"))))
    color = F.get(palette, F.col("ordinal") % len(CONVERSATION_COLORS))
    categories = answer.categories.select(own.alias("id"), F.coalesce("label", own).alias("label"), color.alias("color"), "ordinal", F.coalesce("raw", F.lit("")).alias("raw"))
    return categories, answer.assignments


def categorized_events(inputs: DataFrame, categories: DataFrame, assignments: DataFrame, directory: str = "", link_base: str | None = None) -> DataFrame:
    """assemble() as timeline events: one tab, a group for each category, links to the sources (column path of inputs)."""
    rows = assemble(inputs, categories, assignments)
    source = F.struct(F.lit("email").alias("type"), F.lit("Open thread").alias("label"), X.href_for(F.col("path"), directory, link_base).alias("href"))
    return rows.select(
        F.lit("organized").alias("tab"), (F.col("group_ordinal") * (1 << 40) + F.col("pos")).alias("pos"), F.col("category").alias("group_id"), F.col("category_label").alias("group_label"), F.col("group_ordinal").alias("group_pos"),
        "date", F.coalesce(F.nullif("title", F.lit("")), F.lit("(no subject)")).alias("title"), "category", F.col("from").alias("badge"), X.parties(F.col("sender"), F.col("recipient")).alias("parties"), "summary", "importance", "attachments", source.alias("source"),
    )


def assemble(inputs: DataFrame, categories: DataFrame, assignments: DataFrame) -> DataFrame:
    """Events by category: inputs with category, category_label, color, importance, summary and group_ordinal.

    Of several assignments of an id the last counts; unknown or missing categories become "uncategorized". Groups stand
    in the classifier's order, those that it doesn't list under the same raw id after them by first appearance.
    """
    last = assignments.groupBy("id").agg(F.max_by(F.struct("category", "importance", F.col("summary").alias("said")), "seq").alias("a")).select("id", "a.*")
    known = categories.select(F.col("id").alias("cid"), F.col("label").alias("category_label"), "color", F.when(F.col("raw") == F.col("id"), F.col("ordinal")).alias("listed"))
    rows = inputs.join(last, "id", "left").join(known, F.col("category") == F.col("cid"), "left")
    rows = rows.withColumn("category", F.coalesce("cid", F.lit(UNCATEGORIZED))).withColumn("category_label", F.coalesce("category_label", F.lit("Uncategorized"))).withColumn("color", F.coalesce("color", F.lit(GREY)))
    rows = rows.withColumn("importance", F.coalesce("importance", F.lit(0))).withColumn("summary", F.coalesce(F.nullif("said", F.lit("")), X.snippet(F.col("body"), 200) if "body" in inputs.columns else F.col("snippet")))
    groups = rows.groupBy("category").agg(F.min("listed").alias("listed"), F.min("pos").alias("first"))
    groups = ranked(groups.withColumn("late", F.col("listed").isNull()), ["late", "listed", "first"]).select("category", (F.col("ordinal") - 1).alias("group_ordinal"))
    return rows.drop("cid", "said", "listed").join(groups, "category")
