"""Secrets in texts: fixed patterns, and weak parts of a credential that are reported where its other parts stand by. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def _either(words: str) -> str:
    """A pattern whose lower-case letters stand for both cases, in ASCII."""
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in words)


_SET = "[\"']?\\x20*[:=]\\x20*[\"']?"
ASSIGN = f"({_either('password|passwd|secret|token|api_?key')}){_SET}([A-Za-z0-9+/_.=-]+)"
#: A run that is too short fails as a whole, so the least length can be part of these two.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
_NAMED = f"(?:{_either('pass(?:word|wd|phrase)?|pwd|pin|auth|bearer|credentials?|private_?key|secret|token|api_?key')}){_SET}[^\\x00-\\x20\"'<>,;]{{4,}}"
SECRET = f"{_NAMED}|[A-Za-z0-9+/_-]{{20,}}={{0,2}}"
IDENTIFIER = f"(?:{_either('user(?:_?name)?|login|account|client_?id|key_?id|tenant')}){_SET}[A-Za-z0-9@._+-]{{2,}}"
ENDPOINT = (
    f"(?:{_either('https?|ftp|ssh|sftp|postgres(?:ql)?|mysql|mongodb|redis|amqps?')})://[^\\x00-\\x20\"'<>]+"
    f"|(?:{_either('host|server|endpoint|region')}){_SET}[A-Za-z0-9._:/-]{{3,}}"
)
_USER = "://[^\\x00-\\x20\"'<>/@:]+:[^\\x00-\\x20\"'<>/@]+@"
BREAK = "\\x0A[\\x09\\x0D\\x20]*\\x0A"

BASE = ("assign", "access", "hex")
#: In the order in which spans of one start come; a break is never a span.
KINDS = (*BASE, "secret", "identifier", "endpoint", "break")


def _holds(match: Column) -> dict[str, Column]:
    """Which matches of a kind's pattern count."""
    mixed = match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
    return {"assign": F.char_length(F.regexp_extract(match, ASSIGN, 2)) >= 8, "secret": match.rlike(f"^(?:{_NAMED})$") | mixed}


def _parts(text: str, kind: str, pattern: str) -> Column:
    """Of each match: its kind, number, length, the length of the text between it and the one before, and what it is worth."""
    match = lambda x: x["1"]
    both = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    def part(x: Column, i: Column) -> Column:
        whole = F.when(match(x).rlike(_USER), True).otherwise(False) if kind == "endpoint" else F.lit(False)
        counts = F.coalesce(_holds(match(x)).get(kind, F.lit(True)), F.lit(False))
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("nth"), F.char_length(x["0"]).alias("gap"), F.char_length(match(x)).alias("length"), counts.alias("counts"), whole.alias("whole"))

    parts = F.filter(F.transform(both, part), lambda x: x["length"].isNotNull())
    return F.when(F.col(text).rlike(pattern), parts).otherwise(F.array().cast("array<struct<kind:int,nth:int,gap:int,length:int,counts:boolean,whole:boolean>>"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """The secrets of each whole text: doc_id and spans, an array of (kind, start, end) by start and then kind.

    Starts and ends are in code points, ends exclusive. Strong parts are reported wherever they are:

    - assign: a named value of 8 characters or more; access: an access identifier; hex: a run of 32 or more hexadecimal digits.

    Weak parts are candidates only. They are joined with the other parts of their scope (text between blank lines) whose
    distance is at most `reach` code points, and reported where complementary ones co-occur:

    - secret: a named value, or a token of 20 or more characters of all three classes, that overlaps no other part: if an
      access identifier is near, or both an identifier and an endpoint are.
    - identifier: a named user, account or key: if an endpoint is near and a secret, weak or strong, is too.
    - endpoint: an address: only if it holds a user and a password, which are all parts at once.

    How the intervals are joined: whether a part of some role is near follows from the largest end before and the least
    start after, so running extremes over the parts of a text, in both directions, find it without making pairs. A text's
    parts are sorted in one task; they are a few numbers each.

    Null and empty texts have no spans; repeated rows and null ids are each returned. An empty table gives no rows. Other
    columns are not used.
    """
    kind_of = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    patterns = zip(KINDS, (ASSIGN, ACCESS, HEX, SECRET, IDENTIFIER, ENDPOINT), strict=False)
    found = texts.select("doc_id", "_text", F.concat(*(_parts("_text", k, p) for k, p in patterns)).alias("_parts"))
    found = found.select("doc_id", F.when(F.size("_parts") > 0, F.concat("_parts", _parts("_text", "break", BREAK))).otherwise(F.col("_parts")).alias("_parts"))
    rows = written(found.withColumn("_row", F.monotonically_increasing_id()), "parts")

    each = rows.filter(F.size("_parts") > 0).select("doc_id", "_row", F.inline("_parts"))
    numbered = Window.partitionBy("_row", "kind").orderBy("nth")
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(numbered)).withColumn("start", F.col("end") - F.col("length"))
    each = each.withColumn("role", F.when(F.col("counts"), F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)))

    def before(over: list[str], at: Column) -> Column:
        return F.max(F.when(at, F.col("end"))).over(Window.partitionBy(over).orderBy("start", F.col("role") == "secret", "kind", "nth"))

    def after(over: list[str], at: Column) -> Column:
        return F.min(F.when(at, F.col("start"))).over(Window.partitionBy(over).orderBy(F.desc("start"), F.col("role") != "secret", F.desc("kind"), F.desc("nth")))

    blocks = F.col("role").isNotNull() & ~F.col("role").isin("secret", "break")
    order = Window.partitionBy("_row").orderBy("start", F.col("role") == "secret", "kind", "nth")
    each = each.withColumn("_scope", F.count(F.when(F.col("role") == "break", 1)).over(order))
    each = each.withColumn("_ended", before(["_row"], blocks)).withColumn("_next", after(["_row"], blocks))
    apart = F.coalesce(F.col("_ended") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_next") >= F.col("end"), F.lit(True))
    each = each.withColumn("role", F.when((F.col("role") != "secret") | apart, F.col("role")))

    scope = ["_row", "_scope"]
    roles = {"access": F.col("role") == "access", "identifier": F.col("role") == "identifier", "endpoint": F.col("role") == "endpoint", "secret": F.col("role").isin("assign", "hex", "secret")}
    for name, at in roles.items():
        each = each.withColumn(f"_{name}_before", before(scope, at))
    for name, at in roles.items():
        each = each.withColumn(f"_{name}_after", after(scope, at))
    near = {n: F.coalesce(F.col("start") - F.col(f"_{n}_before") <= reach, F.lit(False)) | F.coalesce(F.col(f"_{n}_after") - F.col("end") <= reach, F.lit(False)) for n in roles}
    weak = F.when(F.col("role") == "secret", near["access"] | (near["identifier"] & near["endpoint"])).when(F.col("role") == "identifier", near["secret"] & near["endpoint"]).when(F.col("role") == "endpoint", F.col("whole"))
    told = F.col("role").isin(*BASE) | F.coalesce(weak, F.lit(False))
    span = F.struct("start", "kind", "end", "role")
    spans = each.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.when(told, span))).alias("_spans"))
    kinds = F.transform("_spans", lambda s: F.struct(s["role"].alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))
    without = rows.filter(F.size("_parts") == 0).select("doc_id", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>").alias("spans"))
    return without.unionByName(spans.select(F.col("doc_id").cast(kind_of), kinds.alias("spans")))
