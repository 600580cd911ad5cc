"""Versions, tags, paths and previews, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: prefixes of tags.
STANDARD_PREFIX = "tag:stsci.edu:asdf/"
YAML_PREFIX = "tag:yaml.org,2002:"
PREVIEW = 64
MAX_U32 = 4294967295
VERSION = r"^([0-9]+)(?:\.([0-9]+)(?:\.([0-9]+))?)?"


def version(text: Column) -> Column:
    """struct(version, major, minor, patch, extra). Text that begins with no number has only zeros; what follows the
    numbers is extra, less one separator after a whole X.Y.Z, and less the point that a missing number follows."""
    part = lambda i: F.least(F.coalesce(F.substr(F.nullif(F.regexp_extract(text, VERSION, i), F.lit("")), F.lit(1), F.lit(18)).cast("bigint"), F.lit(0)), F.lit(MAX_U32))
    head = F.regexp_extract(text, VERSION, 0)
    rest = F.substr(text, F.length(head) + 1)
    whole = F.regexp_extract(text, VERSION, 3) != ""
    cut = F.when(whole, F.regexp_replace(rest, r"^[.\-]", "")).otherwise(F.regexp_replace(rest, r"^\.", ""))
    # an incomplete version keeps an empty extra where a point ends it
    extra = F.when(head == "", None).when(~whole & rest.startswith("."), cut).otherwise(F.nullif(cut, F.lit("")))
    return F.struct(text.alias("version"), part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), extra.alias("extra"))


def tag(text: Column) -> Column:
    """struct(handle, suffix, name, version, is_standard, is_yaml): the tag after its known prefix, split at the last
    hyphen if a digit follows it."""
    standard, yaml = text.startswith(STANDARD_PREFIX), text.startswith(YAML_PREFIX)
    after = lambda p: F.substr(text, F.lit(len(p) + 1))
    handle = F.when(standard, STANDARD_PREFIX).when(yaml, YAML_PREFIX).otherwise(text)
    suffix = F.when(standard, after(STANDARD_PREFIX)).when(yaml, after(YAML_PREFIX)).otherwise("")
    pattern = r"(?s)^(.*)-([0-9][^-]*)$"
    has = suffix.rlike(pattern)
    name = F.when(has, F.regexp_extract(suffix, pattern, 1)).otherwise(suffix)
    number = F.when(has, F.regexp_extract(suffix, pattern, 2))
    return F.struct(handle.alias("handle"), suffix.alias("suffix"), name.alias("name"), number.alias("version"), standard.alias("is_standard"), yaml.alias("is_yaml"))


def tags_match(a: Column, b: Column) -> Column:
    """Equality of whole tags, with or without a leading tag: scheme."""
    plain = lambda x: F.regexp_replace(x, "^tag:", "")
    return plain(a) == plain(b)


def escape_component(text: Column) -> Column:
    """A key as one bare component of a path."""
    return F.regexp_replace(text, r"([/{}\[\].&*\\])", r"\\$1")


def preview(text: Column, limit: int = PREVIEW) -> Column:
    """One line of at most limit columns: runs of control characters become one space, none at either end; what is cut
    ends in three points."""
    line = F.regexp_replace(F.regexp_replace(text, r"^[\x00-\x1f\x7f]+|[\x00-\x1f\x7f]+$", ""), r"[\x00-\x1f\x7f]+", " ")
    return F.when(F.char_length(line) > limit, F.concat(F.substr(line, F.lit(1), F.lit(limit)), F.lit("..."))).otherwise(line)


def display_width(text: Column) -> Column:
    """Code points besides escape sequences."""
    return F.char_length(F.regexp_replace(text, "\x1b\\[[^m]*(m|$)", ""))
