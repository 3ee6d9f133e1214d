"""String helpers as Column expressions (JVM-side, codegen-friendly)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's --------------------------------
# Stop words dropped from token sets (requirement-ref repair, token overlap).
STOPWORDS = [
    "the", "a", "an", "must", "should", "be", "is", "are", "of", "to", "in", "and", "or",
    "not", "no", "for", "that", "this", "it", "its", "with", "at", "on", "any", "each",
    "every", "response", "responses", "model", "output", "outputs",
]
# Typographic look-alikes folded before a quote is searched for, as (from, to).
LOOKALIKES = [
    ("‘", "'"), ("’", "'"), ("‚", "'"), ("‛", "'"),
    ("“", '"'), ("”", '"'), ("„", '"'),
    ("–", "-"), ("—", "-"), ("−", "-"), (" ", " "),
]
# Characters allowed in ids that end up in paths.
ID_UNSAFE = r"[^A-Za-z0-9._-]+"
ID_OK = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
# -----------------------------------------------------------------------------------


def py_repr(s: Column) -> Column:
    """Python ``repr()`` of a str column, for messages (handles quotes, \\ and \\n\\r\\t)."""
    esc = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for raw, rep in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(raw), F.lit(rep))
    use_double = s.contains("'") & ~s.contains('"')
    single = F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), esc, F.lit('"'))
    return F.when(use_double, double).otherwise(single)


def strip_chars(s: Column, chars: str) -> Column:
    """Python ``str.strip(chars)`` for a small literal character set."""
    cls = "".join("\\" + c if c in "\\^-]." else c for c in chars)
    return F.regexp_replace(s, f"^[{cls}]+|[{cls}]+$", "")


def slug(s: Column, max_len: int | None = None) -> Column:
    """Replace runs of unsafe characters by '-', strip '-' and '.'; cut to
    ``max_len`` characters only where the caller asks for it."""
    out = strip_chars(F.regexp_replace(s, ID_UNSAFE, "-"), "-.")
    return F.substring(out, 1, max_len) if max_len else out


def tokens(s: Column) -> Column:
    """Distinct lowercase ``[a-z0-9]+`` words longer than 2 chars, minus stop words."""
    words = F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), 0)
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_distinct(F.filter(
        words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def fold(s: Column) -> Column:
    """Quote-matching normal form: look-alikes to ASCII, lower case, one space per run
    of whitespace, trimmed, then surrounding quote marks stripped."""
    src = "".join(a for a, _ in LOOKALIKES)
    dst = "".join(b for _, b in LOOKALIKES)
    out = F.lower(F.translate(s, src, dst))
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    out = F.regexp_replace(out, r"(?U)^\s+|\s+$", "")
    return strip_chars(out, "\"'")


def html_escape(s: Column) -> Column:
    """``html.escape(s, quote=True)``."""
    out = F.replace(s, F.lit("&"), F.lit("&amp;"))
    for raw, rep in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(rep))
    return out


def substitute(template: Column, values: Column) -> Column:
    """SCL-6: single-pass ``{{name}}`` substitution from a ``map<string,string>``; a name is
    letters, digits and underscores. Unknown names are left as written; substituted text is
    never re-scanned.
    """
    pieces = F.split(template, r"(?=\{\{)|(?<=\}\})")
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(
        F.when(p.rlike(r"^\{\{[A-Za-z0-9_]+\}\}$"),
               F.element_at(values, F.regexp_extract(p, r"^\{\{([A-Za-z0-9_]+)\}\}$", 1))),
        p)), "")
