"""Scalar expressions over text: normalising, tokens, redaction, identifiers, links. All run inside the JVM, except NFKC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.session import prepared


def array_of(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize(c: Column, compatibility: bool = False) -> Column:
    """Lower case, punctuation of paths as spaces, single spaces. ``compatibility`` adds NFKC, which only Python has."""
    if compatibility:
        c = nfkc(c)
    return collapse(F.regexp_replace(F.lower(c), r"[\\/_\-.()\[\]{}／·]", " "))


def nfkc(c: Column) -> Column:
    """NFKC in Arrow batches; text without characters outside Latin-1 and Hangul syllables could skip it."""
    prepared(SparkSession.active())
    return F.pandas_udf(_nfkc, "string", F.PandasUDFType.SCALAR)(c)


def _nfkc(s):
    return s.str.normalize("NFKC")


def normal_text(s: str) -> str:
    """What :func:`normalize` with ``compatibility`` gives, of one string in the driver."""
    import re
    import unicodedata

    return re.sub(r"\s+", " ", re.sub(r"[\\/_\-.()\[\]{}／·]", " ", unicodedata.normalize("NFKC", s).lower())).strip()


def safe_name(name: str, most: int = fixed.FILE_NAME_BYTES) -> str:
    """A file name that a local file can have: NFC, no separators, ``most`` bytes at most with its ending kept."""
    import unicodedata

    def cut(s: str, size: int) -> str:
        return s.encode()[: max(0, size)].decode(errors="ignore")

    out = unicodedata.normalize("NFC", name).replace("/", "／").replace("\\", "＼")
    out = "_" + out if out in (".", "..", "") else out
    if len(out.encode()) <= most:
        return out
    stem, dot, ending = out.rpartition(".")
    if not dot:
        return cut(out, most)
    ending = cut(ending, fixed.FILE_ENDING_BYTES)
    return cut(stem, most - len((dot + ending).encode())) + dot + ending


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(fixed.TOKEN), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(F.lower(c)))


def lexical_terms(query: Column) -> Column:
    """Terms to look for in names: tokens without stop words, numbers and single characters, each followed by itself
    without the first particle that fits, in order, once."""
    stop = array_of(fixed.TERM_STOPWORDS)

    def variants(t: Column) -> Column:
        bare = F.lit(None).cast("string")
        for p in reversed(fixed.PARTICLES):
            cut = F.left(t, F.length(t) - len(p))
            bare = F.when(t.endswith(p) & (F.length(t) - len(p) >= 2), cut).otherwise(bare)
        return F.filter(F.array(t, bare), lambda x: x.isNotNull() & ((x == t) | ~F.array_contains(stop, x)))

    kept = F.filter(tokens(normalize(query)), lambda t: ~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$") & (F.length(t) >= 2) & ~t.rlike("^[0-9]{4}(년|년도)?$"))
    return F.array_distinct(F.flatten(F.transform(kept, variants)))


def segments(root: Column) -> Column:
    """The levels of a folder path, each normalised."""
    return F.transform(F.filter(F.split(root, "/"), lambda s: F.trim(s) != ""), lambda s: normalize(s))


def within(root: Column, folder: str) -> Column:
    """Whether a root lies in a folder, level by level rather than by substring."""
    levels = [s for s in folder.split("/") if s.strip()]
    return F.slice(segments(root), 1, max(1, len(levels))) == F.transform(array_of(levels), lambda s: normalize(s)) if levels else F.lit(True)


def redact(text: Column) -> Column:
    """Values behind credential words, and tokens by their shape, as ``[REDACTED]``."""
    masked = F.regexp_replace(F.regexp_replace(text, fixed.CREDENTIAL, "$1$2[REDACTED]"), fixed.TOKEN_SHAPES, "[REDACTED]")
    return F.when(text.rlike(fixed.REDACT_HINT), masked).otherwise(text)


def permalink(channel_id: Column, thread_ts: Column) -> Column:
    """The archive link of a thread; empty unless both parts have their form."""
    c, t = F.trim(F.coalesce(channel_id, F.lit(""))), F.trim(F.coalesce(thread_ts, F.lit("")))
    fraction = F.rpad(F.regexp_extract(t, fixed.THREAD_TS, 2), 6, "0")
    link = F.concat(F.lit("https://slack.com/archives/"), c, F.lit("/p"), F.regexp_extract(t, fixed.THREAD_TS, 1), fraction)
    return F.when(c.rlike(fixed.CHANNEL_ID) & t.rlike(fixed.THREAD_TS), link).otherwise("")


def uuid5(name: Column, namespace: str = fixed.POINT_NAMESPACE) -> Column:
    """A version-5 UUID: SHA-1 of namespace and name, with version and variant bits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


def clean_url(raw: Column) -> Column:
    """The URL without control characters, or empty if it has white space, another scheme than http(s), or no host."""
    t = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\x00-\x1F\x7F]", ""))
    return F.when(t.rlike(r"(?i)^https?://[^/?#\s]+[^\s]*$"), t).otherwise("")


def clean_title(raw: Column, most: int = 200) -> Column:
    """One line without control characters, 200 characters at most."""
    return F.trim(F.left(collapse(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\x00-\x1F\x7F]", " ")), F.lit(most)))


def primary_id(file_id: Column) -> Column:
    """The first of the ids that a shortcut's field holds."""
    return F.split(F.trim(file_id), r"\s+")[0]


def file_link(file_id: Column) -> Column:
    return F.concat(F.lit("https://drive.google.com/file/d/"), primary_id(file_id), F.lit("/view"))


def human_size(n: Column) -> Column:
    """Bytes with a unit, one decimal from KB on; ``0B`` if not positive."""
    out = F.lit("0B")
    units = ("B", "KB", "MB", "GB", "TB")
    for k in range(4, -1, -1):
        value = F.format_string("%.0fB", n.cast("double")) if k == 0 else F.format_string(f"%.1f{units[k]}", F.bround(n / F.lit(float(1024**k)), 1))
        here = n < 1024 ** (k + 1) if k < 4 else F.lit(True)
        out = value if k == 4 else F.when(here, value).otherwise(out)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, "0B").otherwise(out)


def category(name: Column, mime: Column | None = None) -> Column:
    """The category of a file by its name's ending, then by its MIME type, else ``other``."""
    low = F.lower(name)
    out = F.lit("other")
    if mime is not None:
        for kind in ("text", "audio", "video", "image"):
            out = F.when(mime.startswith(kind + "/"), kind).otherwise(out)
    for kind, endings in reversed(fixed.CATEGORIES):
        out = F.when(low.rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$"), kind).otherwise(out)
    return out


def skip_reason(name: Column, kind: Column) -> Column:
    """Why a file isn't indexed: null if it is."""
    return (
        F.when(name.startswith("~$"), "temporary")
        .when(kind.isin(*fixed.TEXT_CATEGORIES), None)
        .when(kind.isin(*fixed.MODEL_CATEGORIES), "needs_model")
        .when(kind.isin(*fixed.CONVERT_CATEGORIES), "needs_convert")
        .otherwise("not_a_target")
    )


def friendly_reason(error: Column) -> Column:
    out = F.lit(fixed.SKIP_DEFAULT)
    for word, text in reversed(fixed.SKIP_TEXTS):
        out = F.when(error.contains(word), text).otherwise(out)
    return out


def section(line: Column, kinds: Column | None = None) -> Column:
    """The heading that a line is, or null: a bare heading, or a number and a title that can be one. ``kinds``: an array of those
    that count (``chapter``, ``roman``, ``numbered``, ``dotted``, and bare headings in lower case), if not all do."""
    counts = lambda kind: F.lit(True) if kinds is None else F.array_contains(kinds, kind)
    s = F.trim(line)
    bare = F.regexp_replace(s, "[.:]+$", "")
    number, title = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, p in (("chapter", fixed.SECTION_CHAPTER), ("roman", fixed.SECTION_ROMAN), ("numbered", fixed.SECTION_NUMBERED)):
        fits = s.rlike(p) & counts(kind)
        number = F.when(fits, F.regexp_extract(s, p, 1)).otherwise(number)
        title = F.when(fits, F.trim(F.regexp_extract(s, p, 2))).otherwise(title)
    parts_fine = F.forall(F.filter(F.split(number, r"\."), lambda x: x != ""), lambda x: x.try_cast("int") <= 99) & counts("dotted")
    plausible = F.when(number.contains("."), parts_fine).when(number.rlike("^[0-9]+$"), number.try_cast("long") <= 30).otherwise(True)
    fine = plausible & ~title.rlike("[.,;]$") & (F.size(F.split(title, r"\s+")) <= 12)
    named = F.lower(bare).isin(*fixed.BARE_HEADINGS) & counts(F.lower(bare))
    found = F.when(named, bare).when(number.isNotNull() & fine, F.concat_ws(" ", number, title))
    return F.when((s != "") & (F.length(s) <= 100), found)


def numeric_token(token: Column) -> Column:
    """A number, a date or time, or a labelled one, inside quotes or brackets."""
    bare = lambda c: F.trim(F.btrim(F.trim(c), F.lit(fixed.WRAPPERS)))
    t = bare(token)
    value = bare(F.regexp_extract(t, fixed.LABELED_VALUE, 1))
    fits = lambda c: c.rlike(fixed.NUMBER) | c.rlike(fixed.DATE_OR_TIME)
    return fits(t) | (t.rlike(fixed.LABELED_VALUE) & fits(value))


def markdown_text(c: Column) -> Column:
    """Text that can stand in a link: brackets and backslashes escaped."""
    return F.regexp_replace(c, r"([\\\[\]])", r"\\$1")


def markdown_url(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def squeezed(c: Column) -> Column:
    """A name without spaces, hyphens and underscores, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s_-]+", ""))


def citation(name: Column, page: Column, section_: Column, label: Column) -> Column:
    return F.concat_ws(" · ", name, F.when(page.isNotNull(), F.concat(page.cast("string"), F.lit("쪽"))), F.when(section_ != "", F.concat(F.lit("§"), section_)), F.when(label != "", label))
