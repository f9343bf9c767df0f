"""Text cleaning and normalisation as Column expressions: no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes, phrases, markers and patterns that results depend on.
EXTENSIONS = "csv|faiss|html?|jsonl?|log|md|markdown|pdf|rst|txt|ya?ml"
TOOL_TERMS = "artifact|artifacts|generated|logs?|manifest|output|pipeline|reports?|summary|watchdog"
BOILERPLATE = ("not for resale", "permission granted to print", "copyright", "credits")
URL = r"(?i)https?://\S+|www\.\S+"
TAG = r"<[a-zA-Z/][^>]*>"
WRAPPER_LINE = r'\A\s*[\[\]{}",:]+\s*\z'
FILE_NAME = rf"(?i)\b[a-z0-9][a-z0-9_. -]*\.(?:{EXTENSIONS})\b"
DRIVE = r"(?i)\b[a-z]:[\\/]"
PATH = r"(?i)(?:[a-z]:)?(?:[\\/][^\\/\s]+)+"
TRIPLET = r"(?i)\b[a-z0-9_-]+::[a-z0-9_-]+::[a-z0-9_.-]+\b"
TOKEN = r"[a-z0-9]+(?:'[a-z0-9]+)?"
LETTER_WORD = r"[A-Za-z][A-Za-z\-']+"

Text = Column | str


def _col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sub(x: Text, pattern: str, by: str) -> Column:
    return F.regexp_replace(_col(x), F.lit(pattern), F.lit(by))


def strip(x: Text, chars: str | None = None) -> Column:
    """Both ends without white space, or without any of ``chars``."""
    return sub(x, r"\A\s+|\s+\z", "") if chars is None else F.btrim(_col(x), F.lit(chars))


def lines(x: Text) -> Column:
    return F.split(_col(x), "\n")


def join_lines(x: Column) -> Column:
    return F.array_join(x, "\n")


def unix_newlines(x: Text) -> Column:
    return sub(x, "\r\n?", "\n")


def squeeze(x: Text) -> Column:
    return strip(sub(x, r"\s+", " "))


def similarity_text(x: Text) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(squeeze(x))


def sanitize_content(x: Text) -> Column:
    """Prose without paths, file names, drives, a::b::c triplets and tooling words; blank lines dropped, punctuation runs cut to one."""
    y = unix_newlines(x)
    for pattern in (TRIPLET, PATH, FILE_NAME, DRIVE):
        y = sub(y, pattern, " ")
    tidy = lambda line: strip(sub(sub(strip(line), rf"(?i)\b(?:{TOOL_TERMS})\b", " "), r"\s+", " "), " .,:;-_")
    y = join_lines(F.filter(F.transform(lines(y), tidy), lambda line: line != ""))
    y = sub(sub(y, r"([!?.,:;])\1+", "$1"), r"\s+([!?.,:;])", "$1")
    return strip(sub(sub(y, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def looks_like_filename(x: Text) -> Column:
    y = strip(strip(x), "\"'")
    return (y != "") & (y.rlike(DRIVE) | y.rlike(r"[\\/]") | y.rlike(rf"(?i).\.(?:{EXTENSIONS})\z"))


def sanitize_title(x: Text) -> Column:
    """Title made fit to show; null where nothing fit is left."""
    trimmed = " .,:;!?-_"
    y = strip(x)
    y = F.when(y.rlike(r"[\\/]"), F.element_at(F.split(y, r"[\\/]+"), -1)).otherwise(y)
    y = sub(y, rf"(?i)(?<=.)(?:\.(?:{EXTENSIONS}))+\z", "")
    y = strip(sub(sub(F.translate(y, "_-.", "   "), r"([!?.,:;])\1+", "$1"), r"\s+", " "), trimmed)
    only = rf"(?i)\A(?:{TOOL_TERMS})(?:\s+(?:{TOOL_TERMS}))*\z"
    y = F.when(y.rlike(only), F.lit("")).otherwise(y)
    return F.when((y != "") & ~looks_like_filename(y), y)


def fix_glyphs(x: Text) -> Column:
    return F.replace(F.replace(F.replace(F.replace(_col(x), F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit("")), F.lit("\ufb01"), F.lit("fi")), F.lit("\ufb02"), F.lit("fl"))


def dehyphenate(x: Text) -> Column:
    return sub(unix_newlines(x), r"(?U)(\w+)-\n(\w+)", "$1$2")


def mark_lines(x: Column) -> Column:
    """Lines with dashes as '-', bullets as '- ' and numbers of lists with one space behind them."""
    dash = lambda line: sub(line, "[–—]+", "-")
    # fixed values: marks of lists
    bullet = r"\A\s*[•·●►▪-]\s*"
    number = r"\A\s*(\d+[).]|\(\d+\)|[a-z]\))\s+"
    return F.transform(x, lambda line: F.when(dash(line).rlike(bullet), sub(dash(line), bullet, "- ")).otherwise(sub(dash(line), number, "$1 ")))


def tighten(x: Text) -> Column:
    return strip(sub(sub(x, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean_html_text(x: Text) -> Column:
    """Ligatures, hyphenated wraps, bullets, dashes and white space put right."""
    return tighten(join_lines(mark_lines(lines(dehyphenate(fix_glyphs(x))))))


def drop_repeated_lines(x: Column, min_len: int = 14, min_repeats: int = 4) -> Column:
    """Lines without those that recur, bare page numbers and headings of contents."""
    # sorted, a line that recurs has its like min_repeats - 1 places on; the arrays are bound by one-element arrays, so
    # that they are worked out once a text and not once a line
    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    page_number, contents = r"\A\s*\d+\s*\z", ("index", "contents", "table of contents")

    def kept(norm: Column) -> Column:
        sorted_ = F.array_sort(F.filter(norm, lambda n: F.char_length(n) >= min_len))
        often = lambda s: F.array_distinct(F.filter(s, lambda n, i: n == F.get(s, i + min_repeats - 1)))
        gone = lambda o, line, i: F.array_contains(o, F.get(norm, i)) | line.rlike(page_number) | F.lower(strip(line)).isin(*contents)
        return once(once(sorted_, often), lambda o: F.filter(x, lambda line, i: ~gone(o, line, i)))

    return once(F.transform(x, squeeze), kept)


def has_boilerplate(x: Text) -> Column:
    y = F.lower(_col(x))
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(y, F.lit(phrase))
    return found


def count_boilerplate(x: Text) -> Column:
    y = F.lower(_col(x))
    return sum((F.contains(y, F.lit(p)).cast("int") for p in BOILERPLATE), F.lit(0))


def keep_prose_lines(x: Text) -> Column:
    """Lines of a text without blank, wrapper and boilerplate ones, and without urls."""
    kept = F.filter(F.transform(lines(x), lambda s: strip(s)), lambda s: (s != "") & ~s.rlike(WRAPPER_LINE) & ~has_boilerplate(s))
    return join_lines(F.transform(kept, lambda s: sub(s, URL, "")))


def normalize_whitespace(x: Text) -> Column:
    """Non-breaking and zero-width spaces, ligatures, and blank lines squeezed to one."""
    y = F.translate(F.replace(F.replace(_col(x), F.lit("\ufb01"), F.lit("fi")), F.lit("\ufb02"), F.lit("fl")), "\u00a0\u200b", "  ")
    return strip(sub(sub(y, r"[ \t]+", " "), r"\s*\n\s*\n\s*", "\n\n"))


def redact_context(x: Text) -> Column:
    """Text without urls, markdown links, platform, tooling and id terms, and Windows paths."""
    # fixed values: what prompts may not show
    y = sub(sub(x, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"(?i)\b(?:https?://|www\.)\S+", "")
    y = sub(y, r"(?i)\b(?:blogspot|reddit|fandom|wikipedia|dandwiki|homebrewery|github|notion|medium|stackexchange|srd)\b", "")
    y = sub(y, r"(?i)\b[a-z]:\\\S+", "")
    return strip(sub(sub(y, r"[ \t]{2,}", " "), r" +([.,;:!?])", "$1"))


def first_sentence(x: Text, most: int = 120) -> Column:
    """First sentence, cut at the last space within ``most`` characters and marked where it is cut."""
    y = squeeze(x)
    s = F.element_at(F.split(y, r"(?<=[.!?])\s+"), 1)
    cut = F.substring(s, 1, most)
    return F.when(F.char_length(s) <= most, s).otherwise(F.concat(F.rtrim(sub(cut, r" [^ ]*\z", "")), F.lit("…")))


def sentences(x: Text) -> Column:
    return F.filter(F.transform(F.split(squeeze(x), r"(?<=[.!?])\s+"), lambda s: strip(s)), lambda s: s != "")


def normalize_name(x: Text) -> Column:
    return F.trim(sub(F.lower(_col(x)), "[^a-z0-9]+", " "))


def slug(x: Text, most: int = 80) -> Column:
    return F.substring(strip(sub(F.lower(_col(x)), "[^a-z0-9]+", "_"), "_"), 1, most)


def identifier(x: Text) -> Column:
    return strip(sub(F.lower(strip(x)), "[^a-z0-9_.:-]+", "-"), "-")


def source_path(x: Text) -> Column:
    return strip(F.translate(_col(x), "\\", "/"))


def tokens(x: Text) -> Column:
    return F.regexp_extract_all(F.lower(_col(x)), F.lit(TOKEN), F.lit(0))


def letter_tokens(x: Text) -> Column:
    return F.transform(F.regexp_extract_all(_col(x), F.lit(LETTER_WORD), F.lit(0)), F.lower)


def ngrams(x: Column, n: int) -> Column:
    """Joined runs of ``n`` neighbours of an array."""
    parts = [F.slice(x, i + 1, F.greatest(F.size(x) - n + 1, F.lit(0))) for i in range(n)]
    return F.transform(F.arrays_zip(*[p.alias(f"w{i}") for i, p in enumerate(parts)]), lambda s: F.concat_ws(" ", *[s[f"w{i}"] for i in range(n)]))


def word_count(x: Text) -> Column:
    return F.size(F.filter(F.split(_col(x), r"\s+"), lambda w: w != ""))


def unicode_word_count(x: Text) -> Column:
    return F.regexp_count(_col(x), F.lit(r"[\p{L}\p{N}_]+"))


def heading_or_title(heading: Text, title: Text) -> Column:
    return F.coalesce(F.nullif(strip(heading), F.lit("")), F.nullif(strip(title), F.lit("")), F.lit("Document"))
