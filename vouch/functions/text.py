"""String column functions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hint placeholders and the HTML escape table, in the order the
# replacements are applied (ampersand first so later entities stay intact).
ACTUAL_VALUE = "[[ACTUAL_VALUE]]"
LEN_ACTUAL_VALUE = "[[LEN_ACTUAL_VALUE]]"
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]

# Fixed value: the character class kept by name cleaning (ASCII letters and digits).
NAME_CHARS = "a-zA-Z0-9"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_string(c: Column | str, replacement: str = "_") -> Column:
    """Every run of characters outside ``[a-zA-Z0-9]`` becomes one ``replacement``.

    Runs of the replacement itself also collapse, which the single regex
    gives for a one-character replacement that is not alphanumeric.
    """
    if replacement == "":
        raise ValueError("replacement must not be empty")
    if len(replacement) != 1 or replacement.isalnum():
        # General replacement: substitute each character, then collapse the
        # doubled replacement until none is left (bounded by a regex on runs).
        step = F.regexp_replace(_col(c), f"[^{NAME_CHARS}]", replacement)
        esc = "".join("\\" + ch if not ch.isalnum() else ch for ch in replacement)
        return F.regexp_replace(step, f"({esc})+", replacement.replace("\\", "\\\\").replace("$", "\\$"))
    return F.regexp_replace(_col(c), f"[^{NAME_CHARS}]+", replacement.replace("\\", "\\\\").replace("$", "\\$"))


def html_escape(c: Column | str) -> Column:
    out = _col(c)
    for raw, entity in HTML_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def render_hint(hint: Column | str, actual_text: Column, actual_len: Column | None = None) -> Column:
    """Fill the two hint placeholders.

    ``actual_text`` is the value as text (NULL renders as ``None``);
    ``actual_len`` is its length where it has one, else the escaped value is
    used in its place.  A NULL hint stays NULL.
    """
    text = F.coalesce(actual_text, F.lit("None"))
    escaped = html_escape(text)
    length = escaped if actual_len is None else F.coalesce(actual_len.cast("string"), escaped)
    step = F.replace(_col(hint), F.lit(ACTUAL_VALUE), escaped)
    return F.replace(step, F.lit(LEN_ACTUAL_VALUE), length)


def line_count(text: Column | str) -> Column:
    """Lines as the number of newline-separated pieces plus one."""
    return F.size(F.split(_col(text), "\n", -1)) + F.lit(1)


def strip_prefix(path: Column | str, prefix: str) -> Column:
    p = _col(path)
    return F.when(p.startswith(prefix), F.substring(p, len(prefix) + 1, 1 << 30)).otherwise(p)


def path_kind(path: Column | str) -> Column:
    return F.when(_col(path).endswith("/"), F.lit("path")).otherwise(F.lit("file"))


def base_name(path: Column | str) -> Column:
    p = _col(path)
    trimmed = F.regexp_replace(p, "/+$", "")
    return F.substring_index(trimmed, "/", -1)


def rewrite_scheme(path: Column | str, scheme: str, mount: str) -> Column:
    """``scheme:/x`` becomes ``{mount}/x`` (e.g. an object-store URI to a mount)."""
    pattern = "^" + scheme.replace(".", "\\.") + ":/+"
    return F.regexp_replace(_col(path), pattern, mount.rstrip("/") + "/")
