"""Per-user namespace names derived as one projection over a users table."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouch.functions.text import clean_string

# The two built-in catalog names a workspace can start in.
CATALOG_SPARK_DEFAULT = "spark_catalog"
CATALOG_SHARED_DEFAULT = "hive_metastore"
# Schemas that are never listed or cleaned up.
DEFAULT_SCHEMA = "default"
INFORMATION_SCHEMA = "information_schema"
RESERVED_SCHEMAS = [DEFAULT_SCHEMA, INFORMATION_SCHEMA]

# Catalog modes: plain session catalog, catalog-enabled workspace using the
# shared catalog, catalog-enabled workspace with one catalog per user.
MODE_PLAIN = "plain"
MODE_SHARED = "shared"
MODE_PER_USER = "per_user"


@dataclass(frozen=True)
class NamingConfig:
    course_code: str = "demo"
    product: str = "lab"          # middle word of the unique name
    schema_tag: str = "ws"        # leading word of per-user schema names
    lesson: str | None = None
    catalog_mode: str = MODE_PLAIN
    hash_length: int = 4

    @property
    def clean_lesson(self) -> str | None:
        if self.lesson is None:
            return None
        return clean_text(self.lesson.lower())


def clean_text(value: str, replacement: str = "_") -> str:
    """Driver-side twin of ``clean_string`` for configuration values."""
    return re.sub("[^a-zA-Z0-9]+", replacement, value)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_part(user: Column | str) -> Column:
    return F.substring_index(_c(user), "@", 1)


def user_hash(user: Column | str, length: int = 4) -> Column:
    """Stable short hash of the whole user name (hex digits of md5)."""
    return F.substring(F.md5(_c(user)), 1, length)


def unique_name(user: Column | str, cfg: NamingConfig) -> Column:
    u = _c(user)
    return F.lower(F.concat_ws("-", local_part(u), user_hash(u, cfg.hash_length), F.lit(cfg.product), F.lit(cfg.course_code)))


def catalog_prefix(user: Column | str, cfg: NamingConfig) -> Column:
    return F.lower(clean_string(unique_name(user, cfg)))


def catalog_name(user: Column | str, cfg: NamingConfig) -> Column:
    prefix = catalog_prefix(user, cfg)
    own = prefix if cfg.lesson is None else F.lower(clean_string(F.concat_ws("-", prefix, F.lit(cfg.clean_lesson))))
    if cfg.catalog_mode == MODE_PLAIN:
        return F.lit(CATALOG_SPARK_DEFAULT)
    if cfg.catalog_mode == MODE_SHARED:
        return F.lit(CATALOG_SHARED_DEFAULT)
    if cfg.catalog_mode == MODE_PER_USER:
        return own
    raise ValueError(f"unknown catalog mode {cfg.catalog_mode!r}")


def schema_prefix(user: Column | str, cfg: NamingConfig) -> Column:
    u = _c(user)
    raw = F.concat_ws("-", F.lit(cfg.schema_tag), local_part(u), user_hash(u, cfg.hash_length), F.lit(cfg.course_code))
    return F.lower(clean_string(raw))


def schema_name(user: Column | str, cfg: NamingConfig) -> Column:
    prefix = schema_prefix(user, cfg)
    if cfg.lesson is None:
        return prefix
    return F.concat(prefix, F.lit("_"), F.lit(cfg.clean_lesson))


def namespace_columns(user: Column | str, cfg: NamingConfig) -> list[Column]:
    """All derived names for a user column, as one projection."""
    return [
        unique_name(user, cfg).alias("unique_name"),
        catalog_prefix(user, cfg).alias("catalog_prefix"),
        catalog_name(user, cfg).alias("catalog_name"),
        schema_prefix(user, cfg).alias("schema_prefix"),
        schema_name(user, cfg).alias("schema_name"),
    ]


def schema_prefixes_of(schema: Column | str, cfg: NamingConfig) -> Column:
    """All user prefixes that a per-user schema name may start with (empty
    array when it is none).

    A prefix ends with the hash and the course code, followed by ``_`` or the
    end.  A lesson name may hold the same form again, so every such end counts;
    the stale-namespace test is an equi-join on them.  The name is split once
    into its words (between ``_``); a place counts when the words there are the
    course's and the one before is a hash, and only such heads are put together.
    """
    tag, course = clean_text(cfg.schema_tag).lower(), clean_text(cfg.course_code).lower()
    own, after = tag.split("_"), course.split("_")
    name = _c(schema)

    def heads(words: Column) -> Column:
        # Place i (from 1) is the last word of a prefix: the tag, some text, the hash, the course.
        places = F.sequence(F.lit(len(own) + len(after) + 2), F.size(words))
        found = F.filter(places, lambda i: _all([F.get(words, i - len(after) + k) == w for k, w in enumerate(after)])
                         & F.get(words, i - len(after) - 1).rlike(f"^[0-9a-f]{{{cfg.hash_length}}}$"))
        ends = F.transform(found, lambda i: F.array_join(F.slice(words, F.lit(1), i), "_"))
        return F.filter(ends, lambda h: F.char_length(h) > len(tag) + cfg.hash_length + len(course) + 3)  # some text is there

    words = F.split(name, "_")
    enough = name.startswith(f"{tag}_") & (F.size(words) >= len(own) + len(after) + 2)
    none = F.array().cast("array<string>")
    # A lambda variable is bound to the words, so they are split once.
    return F.when(enough, F.transform(F.array(words), lambda w: F.array_distinct(heads(w)))[0]).otherwise(none)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def lesson_bucket(path: Column | str, buckets: int = 10000) -> Column:
    """Deterministic bucket of a text (first 32 bits of md5, modulo ``buckets``)."""
    word = F.conv(F.substring(F.md5(_c(path)), 1, 8), 16, 10).cast("bigint")
    return F.pmod(word, F.lit(buckets))
