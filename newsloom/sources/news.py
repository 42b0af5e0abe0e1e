"""Reading and writing news, extracted events and graph documents (A*, K9, K10, K6 inputs)."""

from __future__ import annotations

import html
import json
import re
import uuid
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import expr
from newsloom.functions.shared import file_system, settle, ship

NEWS_SCHEMA = "id string, source string, title string, content string, url string, published_at string, author string, category string, language string"
EVENT_SCHEMA = (
    "abstract string, event_summary string, event_types array<string>, entities array<string>, entities_original array<string>, entity_roles map<string,array<string>>, "
    "relations array<struct<subject:string,predicate:string,object:string,relation_kind:string,evidence:array<string>>>, event_start_time string, event_start_time_text string, "
    "event_start_time_precision string, source string, published_at string, news_id string, reported_at string"
)


def read_news_jsonl(spark: SparkSession, path: str, schema: str = NEWS_SCHEMA) -> DataFrame:
    """A1: JSON lines; malformed lines are left out."""
    df = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    # a line is malformed as a whole: the columns of its row stay null
    return df.where("_bad is null").drop("_bad")


def normalize_articles(df: DataFrame) -> DataFrame:
    """A2: articles array<struct<url, title, snippet, seendate>> -> news rows: id = url, content and title fall back on each other, the first row per url."""
    a = df.select(F.posexplode("articles").alias("_n", "a"), F.monotonically_increasing_id().alias("_row")).where(F.coalesce("a.url", F.lit("")) != "")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    n = a.select(
        F.col("a.url").alias("id"), F.coalesce(text("a.title"), F.col("a.url")).alias("title"), F.coalesce(text("a.snippet"), text("a.title")).alias("content"),
        F.col("a.url").alias("url"), expr.parse_datetime(F.col("a.seendate")).alias("published_at"), "_row", "_n",
    )
    return n.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy("_row", "_n"))).where("_r = 1").drop("_r", "_row", "_n")


def normalize_search_articles(df: DataFrame) -> DataFrame:
    """A3: rows(title, description, content, url, publishedAt, source struct<name>) -> news rows."""
    return df.select(
        F.col("url").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.nullif("content", F.lit("")), "description", F.lit("")).alias("content"),
        F.coalesce("source.name", F.lit("unknown")).alias("source"), "url", expr.parse_datetime(F.col("publishedAt")).alias("published_at"),
    )


def union_sources(feeds: list[DataFrame], default: str = "unknown") -> DataFrame:
    """A4: all feeds, blank sources filled, newest first."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumn("source", F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit(default))).orderBy(F.desc_nulls_last("published_at"), "id")


def read_events_any(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """A5: extracted events from JSON lines, or from files that hold one object or one list (.json)."""
    whole = path.endswith(".json") if multi_line is None else multi_line
    return spark.read.schema(EVENT_SCHEMA).option("multiLine", whole).json(path)


def events_from_text(df: DataFrame, column: str) -> DataFrame:
    """A5: extracted events from a column of JSON text, each an object or a list."""
    kind = "struct<" + EVENT_SCHEMA.replace(" string", ":string").replace(" array<", ":array<").replace(" map<", ":map<") + ">"
    t = F.trim(F.col(column))
    many = F.when(t.startswith("["), F.from_json(t, f"array<{kind}>")).otherwise(F.array(F.from_json(t, kind)))
    return df.select(F.explode(many).alias("e")).where("e is not null").select("e.*")


def read_extracted_events(spark: SparkSession, glob: str, max_files: int) -> DataFrame:
    """The events of the newest files."""
    df = spark.read.schema(EVENT_SCHEMA).json(glob).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_modification_time").alias("_at"))
    files = df.select("_path", "_at").distinct().withColumn("_n", F.row_number().over(W.orderBy(F.desc("_at"), F.desc("_path")))).where(F.col("_n") <= max_files)
    return df.join(files.select("_path"), "_path", "left_semi").drop("_path", "_at")


def import_documents(spark: SparkSession, entities: str | None, events: str | None) -> tuple[DataFrame | None, DataFrame | None]:
    """Keyed JSON maps of text -> (entities, events): the first source, the first time among reported, published, first seen."""
    ent = "map<string,struct<sources:array<string>,first_seen:string,published_at:string,reported_at:string,original_forms:array<string>>>"
    evt = "map<string,struct<sources:array<string>,first_seen:string,published_at:string,reported_at:string,event_summary:string,entities:array<string>>>"

    def rows(path, kind, name, *more):
        text = spark.read.text(path, wholetext=True)
        j = text.select(F.explode(F.from_json("value", kind)).alias(name, "d"))
        return j.select(name, F.get("d.sources", 0).alias("source"), F.coalesce("d.reported_at", "d.published_at", "d.first_seen").alias("reported_at"), "d.first_seen", *more)

    e = rows(entities, ent, "name", "d.original_forms") if entities else None
    v = rows(events, evt, "abstract", "d.event_summary", "d.entities") if events else None
    return e, v


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)


def export_entities(entities: DataFrame, participants: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entity documents: sources and original forms (sorted), number of events, mentions and sources; mentions(entity_id, source, form)."""
    from newsloom.operators.graph import entity_stats

    lists = mentions.groupBy("entity_id").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("form")).alias("original_forms"))
    return entity_stats(entities, participants, mentions).join(lists, "entity_id", "left")


def export_events(events: DataFrame, participants: DataFrame, relations: DataFrame, defaults: DataFrame) -> DataFrame:
    """A10: event documents: entities, roles by entity, relations, and default observations(event_id, field, value_text) in place of stored fields.

    participants(event_id, name, roles), relations(event_id, subject, predicate, object, evidence).
    """
    p = participants.groupBy("event_id").agg(F.array_sort(F.collect_set("name")).alias("entities"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "roles")))).alias("entity_roles"))
    r = relations.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("subject", "predicate", "object", "evidence"))).alias("relations"))
    o = defaults.groupBy("event_id").agg(F.max(F.when(F.col("field") == "description", F.col("value_text"))).alias("_d"), F.max(F.when(F.col("field") == "start_time", F.col("value_text"))).alias("_s"))
    e = events.join(p, "event_id", "left").join(r, "event_id", "left").join(o, "event_id", "left")
    return e.withColumn("summary", F.coalesce("_d", "summary")).withColumn("start", F.coalesce("_s", "start")).drop("_d", "_s")


def property_graph(entities: DataFrame, events: DataFrame, participants: DataFrame, relations: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, label, name; edges: src, dst, type, time) for a graph store."""
    nodes = entities.select(F.col("entity_id").alias("id"), F.lit("Entity").alias("label"), "name").union(events.select("event_id", F.lit("Event"), "abstract"))
    e = participants.select(F.col("entity_id").alias("src"), F.col("event_id").alias("dst"), F.lit("PARTICIPATED_IN").alias("type"), "time")
    e = e.union(relations.select(expr.entity_id(F.col("subject")), expr.entity_id(F.col("object")), F.lit("RELATION"), "time"))
    return nodes, e.union(edges.select(F.col("from_id").cast("string"), F.col("to_id").cast("string"), F.lit("EVOLVED_TO"), "time"))


def find_news(news: DataFrame, ident) -> DataFrame:
    """The filter reaches the files' statistics."""
    return news.where(F.col("id") == ident)


class Snapshots:
    """Snapshots of graphs under a path. Tables are written to folders of their own first; a manifest that names the folder of every
    graph is then moved into place under the next number, which fails if another writer took it. Readers see the last
    manifest, so all graphs of one write or none, and a writer that dies leaves what was readable before.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs, self._at = file_system(spark, path)

    def _manifests(self) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()) if self._fs.exists(folder) else []

    def current(self) -> dict[str, str]:
        """The folder of each graph type."""
        have = self._manifests()
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{have[-1]}").first()["value"]) if have else {}

    def publish(self, folders: dict[str, str]) -> None:
        """Name these folders as the graphs' current ones; other graphs stay as they are."""
        while True:
            last = max(self._manifests(), default=0)
            text = json.dumps(self.current() | folders)
            made = f"{self.path}/manifests/_{uuid.uuid4().hex}"
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(made)
            if not self._fs.exists(self._at(f"{self.path}/manifests/{last + 1}")) and self._fs.rename(self._at(made), self._at(f"{self.path}/manifests/{last + 1}")):
                return

    def write(self, graphs: dict[str, tuple[DataFrame, DataFrame]], params: str = "") -> None:
        """Nodes, edges and counts of these graphs, all at once."""
        version, folders = f"v-{uuid.uuid4().hex}", {}
        for name, (nodes, edges) in graphs.items():
            at = folders[name] = f"{version}/{name}"
            nodes.write.parquet(f"{self.path}/{at}/nodes")
            edges.write.parquet(f"{self.path}/{at}/edges")
            counts = [self.spark.read.parquet(f"{self.path}/{at}/{n}").count() for n in ("nodes", "edges")]
            self.spark.createDataFrame([(name, *counts, params)], "graph_type string, n_nodes long, n_edges long, params string").write.parquet(f"{self.path}/{at}/meta")
        self.publish(folders)

    def read(self, graph_type: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        at = self.current()[graph_type]
        return tuple(self.spark.read.parquet(f"{self.path}/{at}/{n}") for n in ("nodes", "edges", "meta"))

    def list(self) -> DataFrame:
        """graph_type, n_nodes, n_edges, params of all current snapshots."""
        at = [f"{self.path}/{f}/meta" for f in self.current().values()]
        return self.spark.read.parquet(*at) if at else self.spark.createDataFrame([], "graph_type string, n_nodes long, n_edges long, params string")


def write_snapshot(nodes: DataFrame, edges: DataFrame, graph_type: str, path: str, params: str = "") -> None:
    """One graph's snapshot."""
    Snapshots(nodes.sparkSession, path).write({graph_type: (nodes, edges)}, params)


def read_snapshot(spark: SparkSession, path: str, graph_type: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return Snapshots(spark, path).read(graph_type)


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """graph_type, n_nodes, n_edges of all snapshots."""
    return Snapshots(spark, path).list().select("graph_type", "n_nodes", "n_edges")


def snapshot_all(participants: DataFrame, relations: DataFrame, edges: DataFrame, path: str, top_nodes: int = 500, max_edges: int = 5000) -> DataFrame:
    """All five graphs published under path at once with their counts and parameters, then listed with both.

    participants(event_id, entity_id, time), relations as temporal.relation_states takes them, edges of events.
    """
    from newsloom.operators import graph as G
    from newsloom.operators import temporal as T

    # what several graphs, and the nodes and edges of each, are made from is worked out once
    participants, relations, edges = settle(participants.select("event_id", "entity_id", "time")), settle(relations), settle(edges)
    summary, states = settle(T.relation_summary(relations)), settle(T.relation_states(relations).select("state_id", *T.TRIPLE, "valid_from", "valid_to"))
    graphs = {
        "GE": G.graph_ge(participants, top_nodes, max_edges), "GET": G.graph_get(participants, T.before_edges(participants), top_nodes, max_edges),
        "EE": G.graph_ee(summary, top_nodes, max_edges), "EE_EVO": G.graph_ee_evo(states),
        "EVENT_EVO": G.graph_event_evo(edges, top_nodes, max_edges),
    }
    params = json.dumps({"top_nodes": top_nodes, "max_edges": max_edges})
    made = Snapshots(participants.sparkSession, path)
    made.write(graphs, params)
    return made.list()


# ---------------------------------------------------------------- page text

# Elements whose text is left out, and elements that end a line.
SKIPPED = ("script", "style", "noscript", "svg", "nav", "footer", "header", "aside")
BLOCKS = ("article", "main", "section", "div", "p", "br", "li", "h[1-6]", "blockquote", "pre", "hr")
SENTENCE = "[。！？.!?]"


_OPEN = {t: (re.compile(rf"<{t}\b", re.I | re.A), re.compile(rf"</{t}[ \t\n\f\r]*>", re.I | re.A)) for t in SKIPPED}
_LINE = re.compile(rf"</?(?:{'|'.join(BLOCKS)})\b[^>]*>", re.I | re.A)
_TAG = re.compile(r"<[!/a-zA-Z][^>]*>")
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def _decoded(m: re.Match) -> str:
    """A reference's character; a name that is none, and one without a semicolon, stay as they are."""
    return html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]


def _without(page: str, tag: str) -> str:
    """page without the elements of a tag, each up to the first end tag behind its start tag; one without an end tag stays.

    All positions only move forward, so starts without an end cost no more than others.
    """
    opening, closing = _OPEN[tag]
    ends = [m.span() for m in closing.finditer(page)]
    out, at, gt, k = [], 0, -1, 0
    for m in opening.finditer(page) if ends else ():
        if m.start() < at:
            continue
        if gt < m.start():
            gt = page.find(">", m.start())
        while k < len(ends) and ends[k][0] <= gt:
            k += 1
        if gt < 0 or k == len(ends):
            break
        out.append(page[at : m.start()])
        at = ends[k][1]
    return "".join([*out, page[at:]])


def visible(page: str, skipped: tuple[str, ...] = SKIPPED, references: tuple[str, ...] | None = None) -> str:
    """The page's text with a line break for each tag that ends a line: comments and skipped elements go, then all tags, then references that end with a semicolon are decoded (if named, only those). Linear in the page."""
    out, at = [], 0
    while (i := page.find("<!--", at)) >= 0 and (j := page.find("-->", i + 4)) >= 0:
        out.append(page[at:i])
        at = j + 3
    page = "".join([*out, page[at:]])
    for tag in skipped:
        page = _without(page, tag)
    cut = page.rfind(">") + 1  # behind it no tag ends
    head = _LINE.sub("\n", page[:cut]) + page[cut:]
    cut = head.rfind(">") + 1
    return _REFERENCE.sub(lambda m: _decoded(m) if references is None or m[0] in references else m[0], _TAG.sub("", head[:cut]) + head[cut:])


def page_text(page: Column, most: int = 20_000, least: int = 30, skipped: tuple[str, ...] = SKIPPED, references: tuple[str, ...] | None = None, hard_spaces: bool = False) -> Column:
    """K9: the lines of a page with `least` characters or a sentence mark; a first line of 8 characters may be shorter; at most `most` characters. No-break spaces are spaces unless they are kept."""

    def shown(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: visible(p or "", skipped, references))

    t = ship(F.pandas_udf(shown, "string"))(page)
    t = F.regexp_replace(t if hard_spaces else F.translate(t, "\u00a0", " "), r"[ \t\r\f\x0B]+", " ")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    full = lambda x: (F.length(x) >= least) | x.rlike(SENTENCE)
    usable = F.filter(lines, lambda x: full(x) | (F.length(x) >= 8))
    return F.substring(F.array_join(F.filter(usable, lambda x, i: full(x) | (i == 0)), "\n"), 1, most)


def main_text(pages: DataFrame, most: int = 20_000, **options) -> DataFrame:
    """K9: pages(page_id, url, html) -> page_id, url, text; options as page_text takes them."""
    return pages.select("page_id", "url", page_text(F.col("html"), most, **options).alias("text"))


def enrich_fulltext(news: DataFrame, texts: DataFrame, least: int = 200) -> DataFrame:
    """The page's text in place of the content where it has `least` characters and is longer."""
    j = news.join(texts.select("url", F.col("text").alias("_t")), "url", "left")
    better = (F.length("_t") >= least) & (F.length("_t") > F.length(F.coalesce("content", F.lit(""))))
    return j.withColumn("content", F.when(better, F.col("_t")).otherwise(F.col("content"))).drop("_t")
