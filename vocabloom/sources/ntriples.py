"""N-Triples and N-Quads files as statement tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..vocabulary import RDF, XSD

# possessive quantifiers: a literal of any length is read without recursion
# Groups: subject IRI, its blank node, predicate, object IRI, its blank node, quote, literal, language, datatype, graph.
_LINE = r'^\s*+(?:<([^>]*+)>|_:([^\s]++))\s++<([^>]*+)>\s++(?:<([^>]*+)>|_:([^\s]++)|(")([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:@([A-Za-z0-9-]++)|\^\^<([^>]*+)>)?)\s*+(?:<([^>]*+)>)?\s*+\.\s*+(?:#.*+)?$'
_GROUPS = 10
# The single-letter escapes of the format.
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
c = F.col


def _code_point(hexadecimal: Column) -> Column:
    """The character of a code point, by way of UTF-32; null for numbers that are none."""
    number = F.lpad(hexadecimal, 8, "0")
    return F.when(number.rlike("^(0000(?![dD][89a-fA-F])|000[1-9a-fA-F]|0010)"), F.decode(F.unhex(number), "UTF-32"))


def _plain(text: Column) -> Column:
    """Undo the escapes of a literal or an IRI: pieces that begin with a backslash are replaced one by one."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]++)"), 1)
    letters = F.create_map(*(F.lit(x) for pair in _ESCAPES.items() for x in pair))

    def piece(x: Column) -> Column:
        one = F.substring(x, 2, 1)
        coded = (one.isin("u", "U")) & (F.length(x) > 2)
        return F.when(~x.startswith("\\"), x).when(coded, _code_point(F.substr(x, F.lit(3)))).otherwise(F.coalesce(letters[one], x))

    return F.when(text.contains("\\"), F.array_join(F.transform(pieces, piece), "")).otherwise(text)


def _escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for letter, raw in _ESCAPES.items():
        if letter not in "'\\":
            out = F.replace(out, F.lit(raw), F.lit("\\" + letter))
    return out


# Lines of a written file, and files that a task writes at a time before it sorts what is left.
MOST_LINES, MOST_OPEN = 4_000_000, 64
# The extensions of files that hold statements.
FORMATS = ("ttl", "nt", "nq", "rdf", "trig", "jsonld", "owl", "xml")


def expanded(files: DataFrame, folder: str) -> DataFrame:
    """(path, format): of listed files (path) those right in a folder whose extension is of a known format, each once."""
    name = F.substr("path", F.lit(len(folder) + 2))
    kind = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    return files.filter(c("path").startswith(folder + "/") & ~name.contains("/") & kind.isin(list(FORMATS))).select("path", kind.alias("format")).distinct()


def _place() -> Column:
    """The number of a line's block of 64 KB, then the line's number in its partition (the low 33 bits of its id)."""
    block = F.floor(c("_metadata.file_block_start") / 65536).cast("long")
    return F.shiftleft(block, 33) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def _parts(rows: DataFrame) -> DataFrame:
    """`rows` of lines (value) that are statements, and as _x, in place of the line, the groups of the pattern, "" for those it lacks.

    A line has no line end, so the groups are put between line ends by one run of the pattern. Most lines are three IRIs with a
    space between, and are split at their > alone, which no IRI has inside.
    """
    rows = rows.withColumn("_at", F.split("value", ">"))
    s, p, o = (c("_at")[i] for i in range(3))
    three = (F.size("_at") == 4) & s.startswith("<") & p.startswith(" <") & o.startswith(" <") & (c("_at")[3] == " .")
    none = F.lit("")
    plain = F.array(F.substr(s, F.lit(2)), none, F.substr(p, F.lit(3)), F.substr(o, F.lit(3)), *[none] * (_GROUPS - 4))
    split = F.split(F.regexp_replace("value", _LINE, "".join(f"${i}\n" for i in range(1, _GROUPS + 1))), "\n")
    # An array of one, exploded, is made once: the filter stays above it.
    rows = rows.withColumn("_x", F.explode(F.array(F.when(three, plain).otherwise(split))))
    return rows.filter((F.size("_x") > 1) & (c("_x")[2] != "")).drop("value", "_at")


def _statements(rows: DataFrame) -> DataFrame:
    """Statements of lines (release, file, seq, value)."""
    s, s_node, p, o, o_node, quote, literal, lang, dt, g = (c("_x")[i] for i in range(_GROUPS))
    given = lambda x: F.nullif(x, F.lit(""))
    node = lambda iri, blank: F.when(blank != "", blank).otherwise(_plain(iri))
    kind = lambda blank: F.when(blank != "", "bnode").otherwise("iri")
    return _parts(rows).select(
        "release",
        "file",
        "seq",
        given(g).alias("g"),
        node(s, s_node).alias("s"),
        kind(s_node).alias("s_kind"),
        p.alias("p"),
        F.when(quote != "", _plain(literal)).otherwise(node(o, o_node)).alias("o"),
        F.when(quote != "", "literal").otherwise(kind(o_node)).alias("o_kind"),
        given(lang).alias("lang"),
        F.when(~dt.isin("", XSD + "string", RDF + "langString"), dt).alias("dt"),
    )


def scan(spark: SparkSession, paths: str | list[str], release: str = "") -> DataFrame:
    """Statements of text files: release, file, seq, g, s, s_kind, p, o, o_kind, lang, dt. Lines that aren't statements are left out.

    seq follows the order of the lines of a file: the block it is read in, and the line in its partition.
    """
    return _statements(spark.read.text(paths).select(F.lit(release).alias("release"), c("_metadata.file_path").alias("file"), _place().alias("seq"), "value"))


def write(quads: DataFrame, path: str) -> None:
    """Write statements as N-Triples, a folder for each release and file, in compressed files of at most MOST_LINES lines, as each is read by one task.

    A task has a file of several folders open at a time, so that it needn't sort its statements by folder, on disk if they are many.
    """
    open_files, conf = "spark.sql.maxConcurrentOutputFileWriters", quads.sparkSession.conf
    given = conf.get(open_files, None)
    conf.set(open_files, given if given and int(given) > 0 else MOST_OPEN)
    try:
        lines(quads).write.partitionBy("release", "file").options(compression="lz4", maxRecordsPerFile=MOST_LINES).text(path)
    finally:
        if given is None:
            conf.unset(open_files)
        else:
            conf.set(open_files, given)


def scan_written(spark: SparkSession, path: str) -> DataFrame:
    """The statements of a folder that `write` made, with the release and file of each."""
    text = spark.read.schema("value string, release string, file string").text(path)
    return _statements(text.select("release", "file", _place().alias("seq"), "value"))


def lines(quads: DataFrame) -> DataFrame:
    """Statements as N-Triples text: release, file, value."""
    node = lambda x, kind: F.when(kind == "bnode", F.concat(F.lit("_:"), x)).otherwise(F.concat(F.lit("<"), x, F.lit(">")))
    tail = F.when(c("lang").isNotNull(), F.concat(F.lit("@"), c("lang"))).when(c("dt").isNotNull(), F.concat(F.lit("^^<"), c("dt"), F.lit(">"))).otherwise("")
    literal = F.concat(F.lit('"'), _escaped(c("o")), F.lit('"'), tail)
    target = F.when(c("o_kind") == "literal", literal).otherwise(node(c("o"), c("o_kind")))
    return quads.select("release", "file", F.concat(node(c("s"), c("s_kind")), F.lit(" <"), c("p"), F.lit("> "), target, F.lit(" .")).alias("value"))
