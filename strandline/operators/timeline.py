"""Timeline relations: events from messages, conversations as groups, categories, statistics, the axis and edits.

Events are rows (tab, pos, ...): pos is an event's place in its document, which ties go by. Everything is computed on
rows; only the page (plans.render) gathers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators.ranking import placed, ranked

# The colours that conversations get in turn, those of undeclared categories, and the grey of the rest.
CONVERSATION_COLORS = ["#1E88E5", "#E11D48", "#1D9E75", "#7C3AED", "#E89C1B", "#0EA5E9", "#DB2777", "#16A34A", "#9333EA", "#0D9488", "#D97706", "#6366F1"]
CATEGORY_COLORS = ["#1E88E5", "#E89C1B", "#1D9E75", "#7C3AED", "#C00000", "#0F766E", "#B8860B", "#D81B60"]
OTHER, OTHER_LABEL, GREY = "__default__", "Other", "#6B7280"
# Heights of the axis's dots, and its ends.
HEIGHTS = [30, 48, 66, 38, 58, 34, 52, 70, 44, 62]
LEFT, WIDTH = 60.0, 780.0
#: More conversations than this hide the legend and the category filter.
LEGEND_LIMIT = 8
# Fixed value: what is said of a tab of conversations.
TAB = "%d conversation(s), %d message(s) after dedup."
KEY = 2


def _cycle(values: list, k: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def message_events(unique: DataFrame, tab: str = "timeline", directory: str = "", link_base: str | None = None, tab_col: str | None = None) -> DataFrame:
    """Events of unique messages (unique_messages(), plus path): by time, coloured by conversation, linked to their file.

    All stand in one tab, or in the tabs that tab_col names (unique_messages within that column).

    pos: their order. Importance 2 with attachments, 1 for a conversation's first message, else 0. Conversations are
    subjects without prefixes, told apart by slug: the label is that of the first message.
    """
    own_tab = F.col(tab_col) if tab_col else F.lit(tab)
    rows = ranked(unique.withColumn("tab", own_tab), ["tab", "ts", "first_seen"]).withColumn("pos", F.col("ordinal") - 1)
    topic = F.coalesce(_none(X.base_subject(F.col("subject"))), F.lit("(no subject)"))
    rows = rows.withColumn("topic", topic).withColumn("group_id", X.slug(F.col("topic")))
    first = rows.groupBy("tab", "group_id").agg(F.min("pos").alias("group_pos"), F.min_by("topic", "pos").alias("group_label"))
    rows = rows.join(first, ["tab", "group_id"])
    has = F.size(F.coalesce("attachments", F.array().cast("array<string>"))) > 0
    source = F.struct(F.lit("email").alias("type"), F.lit("Open thread").alias("label"), X.href_for(F.col("path"), directory, link_base).alias("href"))
    return rows.select(
        "tab", "pos", "group_id", "group_label", "group_pos", X.iso_date(F.col("timestamp")).alias("date"),
        F.coalesce(_none(X.strip(X.text(F.col("subject")))), _none(X.base_subject(F.col("subject"))), F.lit("(no subject)")).alias("title"),
        F.concat(F.lit("topic-"), "tab", F.lit("-"), "group_id").alias("category"), X.display_name(F.col("sender")).alias("badge"), X.parties(F.col("sender"), F.col("recipient")).alias("parties"),
        X.snippet(F.col("body"), 240).alias("summary"), F.when(has, 2).when(F.col("pos") == F.col("group_pos"), 1).otherwise(0).alias("importance"), F.lit(None).cast("string").alias("phase"), "attachments", source.alias("source"),
    )


def conversations(events: DataFrame) -> DataFrame:
    """tab, group_id, label, category, n_events, color, ordinal: groups in order of first appearance, colours in turn."""
    groups = events.groupBy("tab", "group_id").agg(F.min("group_pos").alias("first"), F.min_by("group_label", "pos").alias("label"), F.min_by("category", "pos").alias("category"), F.count(F.lit(1)).alias("n_events"))
    out = ranked(groups, ["tab", "first"]).withColumn("ordinal", F.col("ordinal") - 1)
    return out.select("tab", "group_id", "label", "category", "n_events", _cycle(CONVERSATION_COLORS, F.col("ordinal")).alias("color"), "ordinal")


def tab_flags(groups: DataFrame) -> DataFrame:
    """tab, n_groups, legend: whether a tab is small enough for its legend and category filter."""
    return groups.groupBy("tab").agg(F.count(F.lit(1)).alias("n_groups")).withColumn("legend", F.col("n_groups") <= LEGEND_LIMIT)


def conversation_tabs(events: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """tab, label, heading, description, filters, legend, category_filter: what a tab of conversations says of itself.

    labels: tab, label, heading; without it a tab's id is its name.
    """
    groups = tab_flags(conversations(events)).join(events.groupBy("tab").agg(F.count(F.lit(1)).alias("n")), "tab")
    if labels is not None:
        groups = groups.join(labels.select("tab", "label", "heading"), "tab", "left")
    else:
        groups = groups.withColumn("label", X.prettify(F.col("tab"))).withColumn("heading", F.col("label"))
    said = F.format_string(TAB, "n_groups", "n")
    return groups.select("tab", "label", "heading", said.alias("description"), F.lit(True).alias("filters"), "legend", F.col("legend").alias("category_filter"))


def document_tabs(document: DataFrame) -> DataFrame:
    """tab, label, heading, description, summary, filters, legend, category_filter of a document's tabs (null where it doesn't say)."""
    tabs = document.select(F.posexplode("tabs").alias("tab_no", "t"))
    fields = [F.col(f"t.{c}").alias(c) for c in ("label", "heading", "description", "summary", "filters", "legend")]
    return tabs.select(F.coalesce("t.id", F.format_string("tab%d", F.col("tab_no") + 1)).alias("tab"), *fields, F.col("t.categoryFilter").alias("category_filter"))


def flatten_document(document: DataFrame) -> DataFrame:
    """Events of timeline documents (schema.TIMELINE), in document order: tab, pos, group and event fields."""
    tabs = document.select(F.posexplode("tabs").alias("tab_no", "t"))
    groups = tabs.select("tab_no", F.coalesce("t.id", F.format_string("tab%d", F.col("tab_no") + 1)).alias("tab"), F.posexplode("t.groups").alias("group_no", "g"))
    events = groups.select("tab", "tab_no", "group_no", X.slug(F.coalesce(_none(X.text(F.col("g.id"))), F.col("g.label"), F.lit(""))).alias("group_id"), F.col("g.label").alias("group_label"), F.col("g.category").alias("group_category"), F.posexplode("g.events").alias("event_no", "e"))
    rows = ranked(events, ["tab_no", "group_no", "event_no"])
    return rows.select("tab", (F.col("ordinal") - 1).alias("pos"), "group_id", "group_label", "group_category", "e.*")


def flatten_array(events: DataFrame, summary_from_description: bool = False) -> DataFrame:
    """Events of the bare form (group, date, title, ..., pos): one tab, groups of their own names ("Events" without one)."""
    label = F.coalesce(F.col("group").cast("string"), F.lit("Events"))
    rows = events.withColumn("group_label", label).withColumn("group_id", X.slug(label)).withColumn("group_category", X.slug(label)).withColumn("tab", F.lit("timeline"))
    if summary_from_description and "description" in events.columns:
        rows = rows.withColumn("summary", F.coalesce(F.col("summary") if "summary" in events.columns else F.lit(None), F.col("description")))
    return rows.drop("group")


def with_event_ids(events: DataFrame) -> DataFrame:
    """events with id: the given one, else tab-eN by place in the tab, from 1."""
    given = F.col("id") if "id" in events.columns else F.lit(None).cast("string")
    numbered = placed(events.withColumn("__id", given).drop("id"), "tab", ["pos"], "__place")
    return numbered.withColumn("id", F.coalesce(_none(F.col("__id")), F.concat("tab", F.lit("-e"), F.col("__place").cast("string")))).drop("__id", "__place")


def category_registry(events: DataFrame, declared: DataFrame) -> DataFrame:
    """id, label, color, ordinal. declared: id, label, color, ordinal from 0. Categories that only events (category) or
    groups (group_category) name follow in order of appearance. Without a safe colour they get one in turn."""
    first = events.select(F.explode(F.array(*[F.struct(F.col(c).alias("id"), (F.col("pos") * 2 + k).alias("pos")) for k, c in enumerate(("group_category", "category")) if c in events.columns])).alias("x")).select("x.*")
    seen = first.where("id is not null and id <> ''").groupBy("id").agg(F.min("pos").alias("pos"))
    found = seen.join(declared.select("id"), "id", "left_anti").select("id", X.prettify(F.col("id")).alias("label"), F.lit(None).cast("string").alias("color"), F.lit(1).alias("late"), "pos")
    known = declared.select("id", F.coalesce("label", X.prettify(F.col("id"))).alias("label"), X.safe_color(F.col("color")).alias("color"), F.lit(0).alias("late"), F.col("ordinal").cast("long").alias("pos"))
    rows = ranked(known.unionByName(found), ["late", "pos", "id"]).withColumn("ordinal", F.col("ordinal") - 1)
    bare = ranked(rows.where("color is null").select("id", F.col("ordinal").alias("place")), ["place"]).select("id", (F.col("ordinal") - 1).alias("turn"))
    rows = rows.join(bare, "id", "left").withColumn("color", F.coalesce("color", _cycle(CATEGORY_COLORS, F.col("turn"))))
    other = rows.sparkSession.createDataFrame([(OTHER, OTHER_LABEL, GREY)], "id string, label string, color string").withColumn("ordinal", F.lit(None).cast("long"))
    return rows.select("id", "label", "color", "ordinal").unionByName(other)


def resolve_categories(events: DataFrame, registry: DataFrame) -> DataFrame:
    """events with category (the event's, else its group's, else the default), category_label and color."""
    group = F.col("group_category") if "group_category" in events.columns else F.lit(None).cast("string")
    wanted = F.coalesce(_none(F.col("category")), _none(group), F.lit(OTHER))
    rows = events.withColumn("__wanted", wanted).drop("category")
    known = registry.select(F.col("id").alias("category"), F.col("label").alias("category_label"), "color")
    out = rows.join(known, rows["__wanted"] == known["category"], "left")
    fallback = {"category": OTHER, "category_label": OTHER_LABEL, "color": GREY}
    return out.select(*[c for c in rows.columns if c != "__wanted"], *[F.coalesce(c, F.lit(v)).alias(c) for c, v in fallback.items()])


def span(low: Column, high: Column, dash: str = " - ") -> Column:
    return F.when(low.isNull(), F.lit("")).when(low == high, X.long_date(low)).otherwise(F.concat(X.long_date(low), F.lit(dash), X.long_date(high)))


def date_ranges(events: DataFrame, *by: str) -> DataFrame:
    """by, n_events, first_date, last_date, span: dates that can't be read don't count."""
    rows = events.withColumn("__d", X.event_date(F.col("date")))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"), F.min("__d").alias("first_date"), F.max("__d").alias("last_date"))
    return out.withColumn("span", span(F.col("first_date"), F.col("last_date")))


def category_counts(events: DataFrame, label: str = "category_label") -> DataFrame:
    """tab, label, n, first_pos, rank (1: the busiest; ties go to the one seen first)."""
    rows = events.groupBy("tab", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("tab").orderBy(F.desc("n"), "first_pos")))


def key_events(events: DataFrame, most: int | None = None) -> DataFrame:
    """tab, place, title, date of events of importance 2 and more, by date, undated ones last. most: the first ones only.

    With `most` Spark limits the ranks before the shuffle, so a task sends no more than that many events of a tab.
    """
    keyed = events.where(F.coalesce("importance", F.lit(0)) >= KEY).withColumn("__d", X.event_date(F.col("date")))
    order = Window.partitionBy("tab").orderBy(F.col("__d").isNull(), "__d", "pos")
    placed = keyed.select("tab", F.row_number().over(order).alias("place"), "title", "date")
    return placed if most is None else placed.where(F.col("place") <= most)


def tab_stats(events: DataFrame, label: str = "category_label") -> DataFrame:
    """tab, total, first_date, last_date, n_categories, n_key, busiest."""
    rows = events.withColumn("__d", X.event_date(F.col("date")))
    totals = rows.groupBy("tab").agg(F.count(F.lit(1)).alias("total"), F.min("__d").alias("first_date"), F.max("__d").alias("last_date"), F.count_if(F.coalesce("importance", F.lit(0)) >= KEY).alias("n_key"))
    counts = category_counts(events, label)
    per_tab = counts.groupBy("tab").agg(F.count(F.lit(1)).alias("n_categories"), F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("busiest"))
    return totals.join(per_tab, "tab").select("tab", "total", "first_date", "last_date", "n_categories", "n_key", "busiest")


# The wording of a tab's overview and of a filtered view.
OVERVIEW = {
    "none": "No events in this view.", "opening": "This timeline tracks %d event%s%s.", "span": " spanning %s", "tracks": " Work splits across %d tracks — %s — led by %s.",
    "keys": " Key milestones: %s%s.", "more": " and %d more", "untitled": " %d event%s flagged as key.",
}
VIEW = {
    "none": "No events match the current filters.", "filtered": "Filtered to %s: showing ", "all": "Showing ", "opening": "%d of %d events%s. ", "several": "Breakdown: %s. ", "one": "All in %s. ",
    "keys": "Key milestone%s: %s%s.", "more": ", +%d more", "no_keys": "No key milestones in this selection.",
}


def _plural(n: Column) -> Column:
    return F.when(n == 1, F.lit("")).otherwise(F.lit("s"))


def _breakdown(events: DataFrame, label: str, busiest_first: bool) -> DataFrame:
    """tab, parts: "label (n)" of a tab's categories, by first appearance or by size."""
    said = F.concat("label", F.lit(" ("), "n", F.lit(")")).alias("said")
    order = F.struct((-F.col("n") if busiest_first else F.lit(0)).alias("size"), "first_pos", said)
    return category_counts(events, label).groupBy("tab").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["said"]), ", ").alias("parts"))


def _milestones(events: DataFrame, most: int) -> DataFrame:
    """tab, shown (the titles of the first `most` key events), n_shown, n_titled."""
    titled = events.where(F.coalesce("title", F.lit("")) != "")
    first = key_events(titled, most).groupBy("tab").agg(F.array_sort(F.collect_list(F.struct("place", "title"))).alias("k"))
    count = titled.where(F.coalesce("importance", F.lit(0)) >= KEY).groupBy("tab").agg(F.count(F.lit(1)).alias("n_titled"))
    shown = F.array_join(F.transform("k", lambda e: F.concat(F.lit("“"), e["title"], F.lit("”"))), "; ")
    return first.join(count, "tab").select("tab", shown.alias("shown"), F.size("k").alias("n_shown"), "n_titled")


def overview(events: DataFrame, label: str = "category_label", most: int = 4) -> DataFrame:
    """tab, text: a sentence or two on what a tab holds."""
    rows = tab_stats(events, label).join(_breakdown(events, label, False), "tab", "left").join(_milestones(events, most), "tab", "left")
    dates = F.when(F.col("first_date").isNull(), F.lit("")).otherwise(F.format_string(OVERVIEW["span"], span(F.col("first_date"), F.col("last_date"), " – ")))
    opening = F.format_string(OVERVIEW["opening"], "total", _plural(F.col("total")), dates)
    tracks = F.when(F.col("n_categories") > 1, F.format_string(OVERVIEW["tracks"], "n_categories", "parts", "busiest")).otherwise(F.lit(""))
    rest = F.col("n_titled") - F.col("n_shown")
    more = F.when(rest > 0, F.format_string(OVERVIEW["more"], rest)).otherwise(F.lit(""))
    untitled = F.when(F.col("n_key") > 0, F.format_string(OVERVIEW["untitled"], "n_key", _plural(F.col("n_key")))).otherwise(F.lit(""))
    keys = F.when(F.col("n_titled") > 0, F.format_string(OVERVIEW["keys"], "shown", more)).otherwise(untitled)
    return rows.select("tab", F.concat(opening, tracks, keys).alias("text"))


def view_overview(events: DataFrame, view: DataFrame, filters: str = "", label: str = "category_label", most: int = 6) -> DataFrame:
    """tab, n, total, span, n_categories, n_key, text: what a filtered view of each tab holds. filters: what it is filtered to."""
    every = events.groupBy("tab").agg(F.count(F.lit(1)).alias("all_events"))
    rows = every.join(tab_stats(view, label), "tab", "left").join(_breakdown(view, label, True), "tab", "left").join(_milestones(view, most), "tab", "left")
    dates = F.when(F.col("first_date").isNull(), F.lit("")).otherwise(F.concat(X.long_date(F.col("first_date")), F.lit(" – "), X.long_date(F.col("last_date"))))
    n, key = F.coalesce("total", F.lit(0)), F.coalesce("n_key", F.lit(0))
    opening = F.concat(F.format_string(VIEW["filtered"], F.lit(filters)) if filters else F.lit(VIEW["all"]), F.format_string(VIEW["opening"], n, "all_events", F.when(dates != "", F.concat(F.lit(", "), dates)).otherwise(F.lit(""))))
    parts = F.when(F.col("n_categories") > 1, F.format_string(VIEW["several"], "parts")).otherwise(F.format_string(VIEW["one"], "busiest"))
    rest = F.col("n_titled") - F.col("n_shown")
    more = F.when(rest > 0, F.format_string(VIEW["more"], rest)).otherwise(F.lit(""))
    keys = F.when(key > 0, F.format_string(VIEW["keys"], _plural(key), F.coalesce("shown", F.lit("")), F.coalesce(more, F.lit("")))).otherwise(F.lit(VIEW["no_keys"]))
    text = F.when(n == 0, F.lit(VIEW["none"])).otherwise(F.concat(opening, parts, keys))
    return rows.select("tab", n.alias("n"), F.col("all_events").alias("total"), dates.alias("span"), F.coalesce("n_categories", F.lit(0)).alias("n_categories"), key.alias("n_key"), text.alias("text"))


def tab_labels(tabs: DataFrame, folder_col: str = "folder") -> DataFrame:
    """folder, label, heading: tabs in order of their folders' names, numbered where there are several."""
    rows = ranked(tabs.select(F.col(folder_col).alias("folder")).distinct(), ["folder"])
    several = rows.agg(F.count(F.lit(1)).alias("n_tabs"))  # one row
    heading = X.tab_label(F.col("folder"))
    return rows.crossJoin(F.broadcast(several)).select("folder", F.when(F.col("n_tabs") > 1, F.format_string("%d. %s", "ordinal", heading)).otherwise(heading).alias("label"), heading.alias("heading"))


def phase_buckets(events: DataFrame) -> DataFrame:
    """tab, group_id, phase (null: unlabelled), ordinal from 0, n_events, first_date, last_date: phases by first appearance."""
    rows = events.withColumn("__p", X.text(F.col("phase"))).withColumn("__d", X.event_date(F.col("date")))
    out = rows.groupBy("tab", "group_id", "__p").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_events"), F.min("__d").alias("first_date"), F.max("__d").alias("last_date"))
    out = out.withColumn("ordinal", F.row_number().over(Window.partitionBy("tab", "group_id").orderBy("first_pos")) - 1)
    return out.select("tab", "group_id", _none(F.col("__p")).alias("phase"), "ordinal", "n_events", "first_date", "last_date")


def axis_dots(events: DataFrame) -> DataFrame:
    """tab, pos, place, x, y, r of dated events: their place by date decides the height, importance the radius."""
    rows = events.withColumn("__o", F.unix_date(X.event_date(F.col("date")))).where("__o is not null")
    ends = rows.groupBy("tab").agg(F.min("__o").alias("lo"), F.max("__o").alias("hi")).withColumn("hi", F.when(F.col("lo") == F.col("hi"), F.col("lo") + 1).otherwise(F.col("hi")))
    out = placed(rows, "tab", ["__o", "pos"]).join(ends, "tab").withColumn("place", F.col("place") - 1)
    r = F.when(F.col("importance") == 3, 8.5).when(F.col("importance") == 2, 7.0).otherwise(5.5)
    return out.select("tab", "pos", "place", (F.lit(LEFT) + F.lit(WIDTH) * (F.col("__o") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("x"), _cycle(HEIGHTS, F.col("place")).alias("y"), r.alias("r"))


def axis_ticks(events: DataFrame) -> DataFrame:
    """tab, tick (0 to 3), x, label: the ends of the axis and two places between, as month and year."""
    rows = events.withColumn("__o", F.unix_date(X.event_date(F.col("date")))).where("__o is not null")
    ends = rows.groupBy("tab").agg(F.min("__o").alias("lo"), F.max("__o").alias("hi")).withColumn("hi", F.when(F.col("lo") == F.col("hi"), F.col("lo") + 1).otherwise(F.col("hi")))
    ticks = ends.select("tab", "lo", "hi", F.posexplode(F.array(F.lit(0.0), F.lit(1 / 3), F.lit(2 / 3), F.lit(1.0))).alias("tick", "share"))
    day = F.bround(F.col("lo") + F.col("share") * (F.col("hi") - F.col("lo")))
    return ticks.select("tab", "tick", (F.lit(LEFT) + F.lit(WIDTH) * F.col("share")).alias("x"), F.date_format(F.date_from_unix_date(day.cast("int")), "MMM yyyy").alias("label"))


def filtered(events: DataFrame, category: str | None = None, key_only: bool = False) -> DataFrame:
    """The events that a view shows."""
    out = events if category is None else events.where(F.col("category") == category)
    return out.where(F.coalesce("importance", F.lit(0)) >= KEY) if key_only else out


def visible_groups(events: DataFrame, view: DataFrame, *by: str) -> DataFrame:
    """Of the groups or phases (columns `by`) those that still show an event."""
    return events.select(*by).distinct().join(view.select(*by).distinct(), list(by), "left_semi")


def apply_edits(events: DataFrame, overrides: DataFrame, manual: DataFrame) -> DataFrame:
    """events with edits: overrides (id, deleted, and fields that replace where not null), then manual rows appended."""
    fields = [c for c in overrides.columns if c not in ("id", "deleted")]
    o = overrides.select(F.col("id").alias("__id"), F.coalesce("deleted", F.lit(False)).alias("__gone"), *[F.col(c).alias(f"__{c}") for c in fields])
    rows = events.join(o, events["id"] == o["__id"], "left").where("__gone is null or not __gone")
    changed = rows.select(*[F.coalesce(f"__{c}", events[c]).alias(c) if c in fields else events[c] for c in events.columns])
    return changed.unionByName(manual, allowMissingColumns=True)


class Edits:
    """What readers changed in timelines, kept by the slug of a timeline's title: overrides by event id, and events of their own.

    Each save is a file of its own in the title's folder; of several overrides of an event the last counts, field by field.
    """

    OVERRIDES = "id string, deleted boolean, date string, title string, category string, summary string, importance int"
    MANUAL = "id string, tab string, pos long, group_id string, group_label string, date string, title string, category string, summary string, importance int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, title: str) -> str:
        return f"{self.path}/{self.spark.range(1).select(X.slug(F.lit(title))).first()[0]}"

    def save(self, title: str, number: int, overrides: DataFrame | None = None, manual: DataFrame | None = None) -> None:
        """number: larger than those of earlier saves."""
        for kind, rows, schema in (("overrides", overrides, self.OVERRIDES), ("manual", manual, self.MANUAL)):
            if rows is not None:
                given = self.spark.createDataFrame([], schema).unionByName(rows, allowMissingColumns=True)
                given.withColumn("save", F.lit(number).cast("long")).write.mode("append").parquet(f"{self._folder(title)}/{kind}")

    def _read(self, title: str, kind: str, schema: str) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._folder(title)}/{kind}")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema + ", save long")
        return self.spark.read.schema(schema + ", save long").parquet(str(p))

    def load(self, title: str) -> tuple[DataFrame, DataFrame]:
        """(overrides, manual): one row for each event id, as apply_edits takes them."""
        rows = self._read(title, "overrides", self.OVERRIDES)
        fields = [c for c in rows.columns if c not in ("id", "save")]
        last = rows.groupBy("id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("save"))).alias(c) for c in fields])
        own = self._read(title, "manual", self.MANUAL)
        names = [c for c in own.columns if c not in ("id", "save")]
        manual = own.groupBy("id").agg(F.max_by(F.struct(*names), "save").alias("row")).select("id", "row.*")
        gone = last.where("deleted").select("id")
        return last, manual.join(gone, "id", "left_anti")

    def apply(self, title: str, events: DataFrame) -> DataFrame:
        overrides, manual = self.load(title)
        kept = overrides.select("id", "deleted", *[c for c in overrides.columns if c in events.columns and c != "id"])
        return apply_edits(events, kept, manual.select(*[c for c in manual.columns if c in events.columns]))


def reading_places(events: DataFrame) -> DataFrame:
    """events plus place, from 1: a tab's reading order, by date, undated ones last, then by place in the document."""
    rows = events.withColumn("__d", X.event_date(F.col("date"))).withColumn("__undated", F.col("__d").isNull())
    return placed(rows, "tab", ["__undated", "__d", "pos"]).drop("__d", "__undated")


def chronological(events: DataFrame) -> DataFrame:
    """events sorted in their tabs' reading order."""
    return events.withColumn("__d", X.event_date(F.col("date"))).orderBy("tab", F.col("__d").isNull(), "__d", "pos").drop("__d")
