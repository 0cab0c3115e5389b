"""Quads as N-Quads text, one statement per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stemma import model as M

LINES_PER_FILE = 1_000_000

# Escapes of literal text.
ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"),
           ("\b", "\\b"), ("\f", "\\f")]
# Escaped backslashes and quotes, and the ends of terms, while a line is matched. The three are
# noncharacters; a text that holds them has them as numeric escapes meanwhile.
_SLASH, _QUOTE, _CUT = _MARKS = "\uFDD0", "\uFDD1", "\uFDD2"
_BLANK = r"_:[A-Za-z0-9_]++(?:[.-]++[A-Za-z0-9_]++)*+"
# Subject, property, object term, literal's type or language, graph, literal. No part repeats
# a group, so a literal of any length is matched without recursion.
LINE = (rf'^\s*+(<[^>]*+>|{_BLANK})\s*+(<[^>]*+>)\s*+(?:(<[^>]*+>|{_BLANK})|"([^"]*+)"'
        rf'(\^\^<[^>]*+>|@[A-Za-z0-9-]++)?+)\s*+(<[^>]*+>|{_BLANK})?+\s*+\.\s*+(?:#.*)?$')


def _escape(x: Column) -> Column:
    for raw, shown in ESCAPES:
        x = F.replace(x, F.lit(raw), F.lit(shown))
    return x


def _code_points(x: Column, mark: str, digits: int, charset: str) -> Column:
    """Numeric escapes, a run of them at a time, so that pairs stay together."""
    run = rf"(?:\\{mark}[0-9A-Fa-f]{{{digits}}})++"
    shown = F.transform(F.regexp_extract_all(x, F.lit(run), F.lit(0)), lambda r: F.decode(
        F.unhex(F.replace(r, F.lit("\\" + mark), F.lit(""))), charset))
    both = F.arrays_zip(F.split(x, run, -1).alias("text"), shown.alias("shown"))
    whole = F.array_join(F.transform(both, lambda z: F.concat(z.text, F.coalesce(z.shown, F.lit("")))), "")
    return F.when(F.contains(x, F.lit("\\" + mark)), whole).otherwise(x)


def _unescape(x: Column) -> Column:
    x = _code_points(_code_points(x, "u", 4, "UTF-16BE"), "U", 8, "UTF-32")
    for raw, shown in [*ESCAPES[2:], ("'", "\\'")]:
        x = F.replace(x, F.lit(shown), F.lit(raw))
    return F.replace(F.replace(x, F.lit(_QUOTE), F.lit('"')), F.lit(_SLASH), F.lit("\\"))


def _held(x: Column) -> Column:
    """The three marks as numeric escapes."""
    for mark in _MARKS:
        x = F.replace(x, F.lit(mark), F.lit(f"\\u{ord(mark):04X}"))
    return x


def _aside(x: Column) -> Column:
    """Numeric escapes of the marks, of either case, as two characters that no part of a statement holds."""
    return F.when(F.contains(F.lower(x), F.lit("\\ufdd")), F.regexp_replace(
        x, r"\\u[Ff][Dd][Dd]([0-2])", _CUT + "$1")).otherwise(x)


def _restored(x: Column) -> Column:
    for k, mark in enumerate(_MARKS):
        x = F.replace(x, F.lit(f"{_CUT}{k}"), F.lit(mark))
    return x


def nquads_lines(quads: DataFrame) -> DataFrame:
    def iri(c):
        return F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(
            F.concat(F.lit("<"), F.col(c), F.lit(">")))

    kind = F.when(F.col("o_type").startswith("@"), F.col("o_type")).when(
        F.col("o_type").isNotNull(), F.concat(F.lit("^^"), iri("o_type"))).otherwise("")
    literal = F.concat(F.lit('"'), _escape(F.col("o")), F.lit('"'), kind)
    obj = F.when(F.col("o_kind") == "uri", iri("o")).otherwise(literal)
    return quads.select(F.concat_ws(" ", iri("s"), iri("p"), obj, iri("g"), F.lit("."))
                        .alias("value"))


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines as compressed text: statements repeat their URIs, so a file takes a small part of its text.

    A compressed file is read by one task, so none has more than LINES_PER_FILE lines.
    """
    lines.write.mode(mode).option("compression", "gzip").option("maxRecordsPerFile", LINES_PER_FILE).text(path)


def write_nquads(quads: DataFrame, path: str) -> None:
    write_lines(nquads_lines(quads), path)


def _terms_of(value: Column) -> Column:
    """The array of a statement's terms, or one element where there is no statement."""
    held = F.replace(F.replace(_held(value), F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))
    shape = _CUT.join(["$1", "$2", "$3", "$5", "$6", "$4"])
    return F.split(F.regexp_replace(held, LINE, shape), _CUT, -1)


def _matched(lines: DataFrame) -> DataFrame:
    """`lines` with the array `part`: the terms of a statement, or one element where there is none."""
    return lines.withColumn("part", _terms_of(F.col("value")))


# A statement as `nquads_lines` shows it, without escapes: `told` is the line cut at '>', `said` its object cut at '"'.
_NAMED = ("startswith(told[0], '<') and startswith(told[1], ' <') and told[size(told) - 1] = ' .' "
          "and not contains(value, '\\\\')")
_LITERAL = "size(said) = 3 and said[0] = ' '"


def _plain(graph: str | None) -> str:
    """The quad of such a statement, null for any other line."""
    def row(o, kind, o_type, g):
        return (f"named_struct('s', substr(told[0], 2), 'p', substr(told[1], 3), 'o', {o}, 'o_kind', '{kind}', "
                f"'o_type', {o_type}, 'g', {f'`{graph}`' if graph else g})")

    no_type, g = "cast(null as string)", "substr(told[3], 3)"
    return f"""case when not ({_NAMED}) then null
        when size(told) = 5 and not startswith(told[3], ' <') then null
        when size(told) = 5 and startswith(told[2], ' <') then {row("substr(told[2], 3)", "uri", no_type, g)}
        when size(told) = 5 and {_LITERAL} and startswith(said[2], '^^<') then
          {row("said[1]", "literal", "substr(said[2], 4)", g)}
        when size(told) = 4 and {_LITERAL} and startswith(said[2], ' <') then
          {row("said[1]", "literal", no_type, "substr(said[2], 3)")} end"""


def parse_nquads(lines: DataFrame, graph: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Quads of text lines (column value), each matched once.

    A language tag is kept as an o_type that starts with '@', a blank node as a URI that
    starts with '_:', a statement without graph has a null g. Where a column `graph` is
    named, it is the graph of all. Columns of `keep` are passed on. `rejected_lines` has what is no
    statement.

    Most lines are spaced as `nquads_lines` does it and hold no escape: these are cut at '>' and '"', which takes a small part
    of the time of a match. All others are matched by LINE, with the same terms.
    """
    def part(i):
        return F.col("part")[i]

    def bare(x, opening, closing):
        return F.when(x.startswith(opening), F.substring(x, F.lit(len(opening) + 1), F.length(x) - len(opening + closing))
                      ).otherwise(x)

    def plain(x, told):
        """Few terms hold a numeric escape or a mark; the others need not be searched for each."""
        return F.when(F.contains(x, F.lit("\\")) | F.contains(x, F.lit(_SLASH)) | F.contains(x, F.lit(_QUOTE)), told(x)
                      ).otherwise(x)

    def term(i):
        return F.when(part(i) != "", plain(bare(part(i), "<", ">"), lambda x: _restored(_aside(x))))

    is_uri = part(2) != ""
    row = F.struct(
        term(0).alias("s"), term(1).alias("p"),
        F.when(is_uri, term(2)).otherwise(plain(part(5), lambda x: _restored(_unescape(_aside(x))))).alias("o"),
        F.when(is_uri, F.lit("uri")).otherwise(F.lit("literal")).alias("o_kind"),
        F.when(part(3) != "", bare(part(3), "^^<", ">")).alias("o_type"),
        (F.col(graph) if graph else term(4)).alias("g"))
    cut = lines.withColumn("told", F.split("value", ">", -1)).withColumn(
        "said", F.when(F.size("told").isin(4, 5) & ~F.startswith(F.col("told")[2], F.lit(" <")), F.split(F.col("told")[2], '"', -1)))
    cut = cut.withColumn("plain", F.expr(f"case when size(told) in (4, 5) then {_plain(graph)} end")).withColumn(
        "part", F.when(F.col("plain").isNull(), _terms_of(F.col("value"))))
    # A filter would be moved below the match and make a second one.
    return cut.select(F.inline(F.when(F.col("plain").isNotNull(), F.array("plain")).when(
        F.size("part") == 6, F.array(row)).otherwise(F.array())), *(keep or []))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither statements nor comments nor blank."""
    return (_matched(lines).filter((F.size("part") != 6) & ~F.col("value").rlike(r"^\s*(#.*)?$"))
            .select("value"))


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    return parse_nquads(spark.read.text(path))


def read_records(spark: SparkSession, path: str, base: str = M.BASE) -> DataFrame:
    """Files named by record id, compressed or not; their statements go to graph base + id + '/'."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    name = F.regexp_replace("file", r"\.[A-Za-z]+(\.gz)?$", "")
    graph = F.concat(F.lit(base), name, F.lit("/"))
    return parse_nquads(lines.withColumn("graph", graph), "graph")
