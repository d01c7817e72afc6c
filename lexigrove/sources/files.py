"""Documents from directories of text, JSON and XML files, and from older postings files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.session import keep_until_exit, shared_dir, stage

# The namespace, and where below the root a title may stand, in order of preference.
_TEI = "http://www.tei-c.org/ns/1.0"
_TITLES = (("title",), ("head", "title"), ("text", "body", "head", "title"))


class _Leads:
    """Collects, in one pass over an XML text, what each element begins with, and the first element at each place of a title."""

    def __init__(self) -> None:
        self.leads: list[list[str]] = []
        self.open: list[tuple[str, int]] = []  # names and numbers of the open elements
        self.fresh = False
        self.titles: dict[tuple[str, ...], int] = {}
        self.parser = expat.ParserCreate(namespace_separator="}")
        self.parser.StartElementHandler = self.begin
        self.parser.EndElementHandler = self.end
        self.parser.CharacterDataHandler = self.text

    def begin(self, name: str, _: dict) -> None:
        self.open.append((name, len(self.leads)))
        self.leads.append([])
        self.fresh = True
        space, _, _ = name.rpartition("}")
        if space == _TEI:
            names = [n.rpartition("}") for n, _ in self.open[1:]]
            if all(n[0] == _TEI for n in names):
                self.titles.setdefault(tuple(n[2] for n in names), self.open[-1][1])

    def end(self, _: str) -> None:
        self.open.pop()
        self.fresh = False

    def text(self, data: str) -> None:
        if self.fresh:
            self.leads[-1].append(data)


def read_xml(text: str) -> tuple[str, str, str | None]:
    """Title, content and problem of a TEI-like document.

    The content has the elements' own leading texts, one to a line; tails and blank
    texts are left out.  A text that isn't well formed has no title and content, and
    its problem says where.
    """
    seen = _Leads()
    try:
        seen.parser.Parse(text, True)
    except expat.ExpatError as error:
        return "", "", f"xml: {error}"
    leads = ["".join(parts) for parts in seen.leads]
    title = next((leads[seen.titles[p]] for p in _TITLES if p in seen.titles and leads[seen.titles[p]]), "")
    return title, "\n".join(lead for lead in leads if lead.strip()), None


def _xml_columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        read = [("", "", None) if t is None else read_xml(t) for t in batch["value"]]
        yield pd.DataFrame({"path": batch["path"], **{c: [r[i] for r in read] for i, c in enumerate(("title", "content", "problem"))}})


def text_files(raw: DataFrame) -> DataFrame:
    """Title from the file's name, content as it is."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return raw.select("path", F.url_decode(stem).alias("title"), F.col("value").alias("content"))


def json_files(raw: DataFrame) -> DataFrame:
    """Members ``title`` and ``body`` of one object to a file; missing ones are empty.

    A text that isn't one whole JSON object has empty ones and a problem.
    """
    row = F.from_json("value", "title STRING, body STRING, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    read = raw.select("path", "value", row.alias("row"))
    whole = F.col("row._bad").isNull() & F.rtrim("value").endswith("}")

    def member(name: str) -> Column:
        return F.when(whole, F.coalesce(f"row.{name}", F.lit(""))).otherwise("")

    return read.select("path", member("title").alias("title"), member("body").alias("content"), F.when(F.col("value").isNotNull() & ~F.coalesce(whole, F.lit(False)), "json: not one whole object").alias("problem"))


def xml_files(raw: DataFrame) -> DataFrame:
    """TEI-like files; see :func:`read_xml`."""
    return raw.mapInPandas(_xml_columns, "path string, title string, content string, problem string")


Reader = Callable[[DataFrame], DataFrame]
READERS: dict[str, Reader] = {"txt": text_files, "json": json_files, "xml": xml_files}


class Corpus:
    """A table of documents with the lookups of a collection."""

    def __init__(self, documents: DataFrame) -> None:
        self.documents = documents

    @staticmethod
    def from_directory(spark: SparkSession, path: str, extensions: list[str] | None = None, predicate: Column | None = None, readers: dict[str, Reader] | None = None) -> Corpus:
        """``(doc_id, title, content, format, problem)`` of the files below a directory; ids count from 0 in order of the paths.

        ``problem`` is null, or says why a file couldn't be read; such a file is a
        document without text, and the others are read all the same.

        ``extensions`` (case counts) limits the formats, ``predicate`` the paths
        (a column over ``path``), and ``readers`` adds formats; built-in formats
        can't be replaced.  A format without a reader raises.  Files whose names
        begin with ``_`` or ``.`` are skipped, and so are files of no bytes, which
        Spark's listing leaves out.  No file, no row.
        """
        known = {**(readers or {}), **READERS}
        wanted = list(known) if extensions is None else [e.lstrip(".") for e in extensions]
        for name in wanted:
            if name not in known:
                raise ValueError(f"unsupported file type: {name}")
        parts = []
        for name in wanted:
            raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{name}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
            raw = raw.where(predicate) if predicate is not None else raw
            read = known[name](raw).withColumn("format", F.lit(name))
            parts.append(read if "problem" in read.columns else read.withColumn("problem", F.lit(None).cast("string")))
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return Corpus(numbered(rows, "path").select("doc_id", "title", "content", "format", "problem"))

    def problems(self) -> DataFrame:
        """``(doc_id, problem)`` of the files that couldn't be read."""
        return self.documents.where("problem IS NOT NULL").select("doc_id", "problem")

    @staticmethod
    def from_table(df: DataFrame, doc_id: str = "doc_id", content: str = "text", title: str | None = "title", fmt: str | None = None) -> Corpus:
        """Documents that are a table already."""
        name = F.col(title) if title else F.lit("")
        kind = F.col(fmt) if fmt else F.lit("txt")
        return Corpus(df.select(F.col(doc_id).cast("long").alias("doc_id"), name.alias("title"), F.col(content).alias("content"), kind.alias("format"), F.lit(None).cast("string").alias("problem")))

    def __len__(self) -> int:
        return self.documents.count()

    def get(self, doc_id: int) -> DataFrame:
        """The document with an id, or no row."""
        return self.documents.where(F.col("doc_id") == doc_id)

    def display(self) -> DataFrame:
        """Each document as ``title (ID id)``; a missing title is empty."""
        return self.documents.select("doc_id", F.format_string("%s (ID %d)", F.coalesce("title", F.lit("")), "doc_id").alias("display"))


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``doc_id`` from 0 in order of ``by``, which must be unique; no task sees more than a partition.

    Rows are ranged and sorted, written, and shifted by the sizes of the
    partitions before theirs; only those sizes come to the driver.
    """
    placed = stage(rows.orderBy(by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "p long, start long")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("p", part).join(F.broadcast(offsets), "p").withColumn("doc_id", F.col("start") + within).drop("p", "start", "_at")


_XML_OUT = r"[^\t\n\r -\uD7FF\uE000-\uFFFD\x{10000}-\x{10FFFF}]"


def tei_text(title: Column, text: Column) -> Column:
    """A TEI-like document of a title and a text; characters that XML can't hold are left out."""

    def escaped(column: Column) -> Column:
        out = F.regexp_replace(F.coalesce(column, F.lit("")), _XML_OUT, "")
        for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
            out = F.replace(out, F.lit(c), F.lit(name))
        return out

    return F.concat(F.lit(f'<TEI xmlns="{_TEI}"><head><title>'), escaped(title), F.lit("</title></head><p>"), escaped(text), F.lit("</p></TEI>"))


def write_files(rows: DataFrame) -> str:
    """Write each row of ``(name, value)`` as a file of its own below a new shared folder, and return the folder."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/lexigrove-{uuid.uuid4().hex}/files"
    keep_until_exit(spark, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, value in zip(batch["name"], batch["value"]):
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write((value or "").encode())
            yield pd.DataFrame({"n": [len(batch)]})

    rows.select("name", "value").mapInPandas(run, "n long").agg(F.sum("n")).collect()
    return folder


def merged_lines(postings: DataFrame) -> DataFrame:
    """``value``: a line ``term: id,[p, p];id,[p]`` for each term and block of document ids, as :func:`merged_postings` reads them.

    A term that stands in very many documents has several lines.  Line breaks within
    terms are written as spaces, as the format has no way to hold them.
    """
    one = F.concat(F.col("doc_id").cast("string"), F.lit(",["), F.array_join(F.col("positions").cast("array<string>"), ", "), F.lit("]"))
    listed = postings.groupBy("term", F.shiftright("doc_id", 16).alias("block")).agg(F.array_sort(F.collect_list(F.struct("doc_id", one.alias("one")))).alias("l"))
    return listed.select(F.concat(F.translate("term", "\r\n", "  "), F.lit(": "), F.array_join(F.col("l.one"), ";")).alias("value"))


def merged_postings(spark: SparkSession, path: str) -> DataFrame:
    """``(term, doc_id, tf, positions)`` from lines ``term: id,[p, p];id,[p]``."""
    line = F.regexp_extract("value", r"^(.*?): (.*)$", 2)
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^(.*?): (.*)$", 1).alias("term"), F.explode(F.split(line, ";")).alias("one"))
    numbers = F.split(F.regexp_replace(F.regexp_extract("one", r"\[(.*)\]", 1), r"['\s]", ""), ",")
    rows = rows.select("term", F.regexp_extract("one", r"^\s*(\d+)", 1).cast("long").alias("doc_id"), F.sort_array(numbers.cast("array<int>")).alias("positions"))
    return rows.select("term", "doc_id", F.size("positions").cast("long").alias("tf"), "positions")
