"""Text for responses and sinks: escaping, formats, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc3339(moment: Column) -> Column:
    """UTC to the second, fractions dropped."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def unix_seconds(moment: Column) -> Column:
    return F.unix_timestamp(moment)


def escape_like(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def url_segment(text: Column) -> Column:
    """Percent-encoded for a path; a blank is %20, and ``! ' ( ) ~`` stand as they are."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def package_path(name: Column, version: Column | None = None) -> Column:
    """The page of a package, or of one of its releases."""
    page = F.concat(F.lit("/pkg/"), url_segment(name))
    return page if version is None else F.concat(page, F.lit("/"), url_segment(version))


def query_path(path: Column, **fields: Column) -> Column:
    """A path with the fields that aren't null or empty as its query."""
    said = [F.when(v != "", F.concat(F.lit(f"{k}="), url_segment(v))) for k, v in fields.items()]
    asked = F.concat_ws("&", *said)
    return F.when(asked == "", path).otherwise(F.concat(path, F.lit("?"), asked))


def highlight(text: Column, phrase: str) -> Column:
    """HTML of a text with the first occurrence of a phrase, whatever its case, marked."""
    at = F.locate(phrase.lower(), F.lower(text))
    cut = lambda a, b: escape_html(text.substr(a, b))
    n = F.lit(len(phrase))
    marked = F.concat(cut(F.lit(1), at - 1), F.lit("<mark>"), cut(at, n), F.lit("</mark>"), cut(at + n, F.length(text)))
    return F.when((at > 0) & F.lit(bool(phrase)), marked).otherwise(escape_html(text))


def etag(body: Column) -> Column:
    """The first 27 characters of the URL-safe base64 of a body's SHA-256."""
    return F.substring(F.translate(F.base64(F.unhex(F.sha2(body, 256))), "+/", "-_"), 1, 27)


def copy_field(c: Column, kind: str) -> Column:
    r"""One field of a tab-separated bulk load: ``\N`` for null, t or f, ``\x`` and hex for bytes, JSON for nested values."""
    if kind == "boolean":
        text = F.when(c, "t").otherwise("f")
    elif kind == "binary":
        text = F.concat(F.lit("\\x"), F.lower(F.hex(c)))
    elif kind.startswith(("array", "struct", "map")):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.when(c.isNull(), "\\N").otherwise(text)


def copy_line(columns: list[tuple[str, str]]) -> Column:
    """The whole line of a row, without its end; ``columns`` are (name, type) as in ``DataFrame.dtypes``."""
    return F.concat_ws("\t", *(copy_field(F.col(c), k) for c, k in columns))


def omit_empty(columns: list[tuple[str, str]]) -> Column:
    """JSON object of the columns without those that are null, "", false, 0 or an empty array."""

    def kept(c: str, kind: str) -> Column:
        col = F.col(c)
        if kind == "string":
            return F.when(col != "", col)
        if kind == "boolean":
            return F.when(col, col)
        if kind.startswith("array"):
            return F.when(F.size(col) > 0, col)
        if kind in ("int", "bigint", "double", "smallint", "float"):
            return F.when(col != 0, col)
        return col

    return F.to_json(F.struct(*(kept(c, k).alias(c) for c, k in columns)))


def plural(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))


def integer(n: Column) -> Column:
    return F.format_number(n, 0)


def byte_size(n: Column) -> Column:
    """1536 as ``1.5 KiB``; bytes are whole."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        shown = F.concat(F.format_string("%.1f", n / F.lit(1024.0**k)), F.lit(f" {unit}"))
        out = out.when(F.lit(unit == "TiB") | (n < 1024.0 ** (k + 1)), shown)
    return out


def ago(moment: Column, now: Column) -> Column:
    """How long ago, as ``elapsed`` says it."""
    return elapsed(F.unix_timestamp(now) - F.unix_timestamp(moment))


def elapsed(n: Column) -> Column:
    """So many seconds ago in one coarse unit, each rounded from the one before."""
    steps = (("minute", 60, 60), ("hour", 60, 24), ("day", 24, 60), ("month", 30.4, 24), ("year", 365.25, None))
    out = F.when(n < 0, "in the future").when(n < 60, "just now")
    days = None
    for unit, size, below in steps:
        n = F.floor((days if unit in ("month", "year") else n) / size + 0.5)
        days = n if unit == "day" else days
        shown = F.concat(plural(n, unit), F.lit(" ago"))
        out = out.otherwise(shown) if below is None else out.when(n < below, shown)
    return out


def iso(moment: Column) -> Column:
    """UTC to the millisecond."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _time_tag(moment: Column, text: Column, titled: bool) -> Column:
    title = F.concat(F.lit('" title="'), iso(moment)) if titled else F.lit("")
    return F.concat(F.lit('<time datetime="'), iso(moment), title, F.lit('">'), text, F.lit("</time>"))


def time_tag(moment: Column) -> Column:
    """HTML of a moment to the minute."""
    return _time_tag(moment, F.date_format(moment, "yyyy-MM-dd HH:mm 'UTC'"), titled=False)


def day_tag(moment: Column) -> Column:
    return _time_tag(moment, F.date_format(moment, "yyyy-MM-dd"), titled=True)


def ago_tag(moment: Column, now: Column) -> Column:
    return _time_tag(moment, ago(moment, now), titled=True)


def short_system(system: Column) -> Column:
    """``x86_64 linux``: the first dash is a blank."""
    return F.regexp_replace(system, "^([^-]*)-", "$1 ")


def quoted(text: Column) -> Column:
    """A JSON string."""
    one = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), one.substr(F.lit(6), F.length(one) - 6))


def describe_query(phrase: Column, name: Column, version: Column, system: Column) -> Column:
    """What was asked for, in words of the query; empty and null fields are left out. The wording is a fixed value, as responses must read alike."""
    doubled = F.replace(phrase, F.lit('"'), F.lit('""'))
    full_text = F.concat(F.lit('^"'), doubled, F.lit('" OR ^"'), doubled, F.lit('"* OR "'), doubled, F.lit('" OR "'), doubled, F.lit('"*'))
    said = [F.when(phrase != "", F.concat(F.lit("phrase = "), quoted(phrase), F.lit(" = "), quoted(full_text)))]
    said += [F.when(c != "", F.concat(F.lit(f"{k} = "), quoted(c))) for k, c in (("name", name), ("version", version), ("system", system))]
    return F.concat_ws(" && ", *said)
